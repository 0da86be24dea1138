"""Column-expression helpers (JVM-side, codegen friendly)."""

from quiltspark.functions.keys import key_to_long, seeded_key, sql_key, sql_key_to_long
from quiltspark.functions.mathx import erf, frobenius, normal_cdf, sigmoid

__all__ = [
    "erf",
    "frobenius",
    "key_to_long",
    "normal_cdf",
    "seeded_key",
    "sigmoid",
    "sql_key",
    "sql_key_to_long",
]
