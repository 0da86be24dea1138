"""Seeded, layout-independent random keys.

``md5('<seed>:<tag>:' || id)`` gives every row a pseudo-random key that depends
only on the seed, a tag (split name, round, purpose) and the row id -- never on
the number of partitions or executors.  Sorting by it is a portable random
permutation; its first 15 hex digits are a uniform 60-bit integer.  The same
expressions exist in DuckDB, which makes every sampling operator checkable
against an SQL oracle.  Only integer ids or strings are hashed: doubles print
differently across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(seed: int, tag: str, id_col) -> Column:
    """Hex md5 key of ``'<seed>:<tag>:' || id``."""
    return F.md5(F.concat(F.lit(f"{seed}:{tag}:"), _col(id_col).cast("string")))


def key_to_long(key) -> Column:
    """Uniform non-negative 60-bit integer from the first 15 hex digits of a key."""
    return F.conv(F.substring(_col(key), 1, 15), 16, 10).cast("long")


def uniform01(key) -> Column:
    """Uniform double in [0, 1) from a key."""
    return key_to_long(key).cast("double") / F.lit(float(16**15))


def sql_key(seed: int, tag: str, id_expr: str) -> str:
    """DuckDB form of :func:`seeded_key`."""
    return f"md5('{seed}:{tag}:' || CAST({id_expr} AS VARCHAR))"


def sql_key_to_long(key_expr: str) -> str:
    """DuckDB form of :func:`key_to_long`."""
    return f"CAST(('0x' || substr({key_expr}, 1, 15)) AS BIGINT)"
