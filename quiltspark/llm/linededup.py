"""Operator 6: removal of repeated passages of three or more lines.

The lines of a text are what stands between line feeds.  Every three
consecutive lines are a window; its key is a pair of 64-bit hashes.  A window
whose key occurs more than once in the corpus (within one document or in
several) is repeated; its first occurrence, by (doc_id, text hash, position),
stays and every later one covers its three lines.  Covered positions of
overlapping windows merge, and the covered lines are removed.

Windows of blank (white space only) lines alone are left out.  A document of
fewer than three lines has no window and stays.  A null or empty text stays as
it is.  Rows with equal doc_id and text count as one document and get one
result each.  Null ids sort first.  An empty table gives an empty result.
Other columns are kept; names starting with ``_w_`` are refused.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WINDOW = 3


def _without(texts: pd.Series, starts: pd.Series) -> pd.Series:
    """Each text without the lines covered by windows starting at ``starts``."""
    out = []
    for text, first in zip(texts, starts, strict=True):
        if text is None or first is None or not len(first):
            out.append(text)
            continue
        covered = {int(s) + k for s in first for k in range(WINDOW)}
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in covered))
    return pd.Series(out, dtype=object)


def windows(docs: DataFrame) -> DataFrame:
    """_w_a, _w_b (key), _w_doc (doc_id, text hash), _w_at (first line, from 0)."""

    def keys(lines: Column, seed: int) -> Column:
        # elements of a window are separate arguments, so no joint of lines is ambiguous
        return F.transform(
            F.sequence(F.lit(1), F.size(lines) - (WINDOW - 1)),
            lambda i: F.struct(
                F.xxhash64(*[F.element_at(lines, i + k) for k in range(WINDOW)]).alias("a"),
                F.xxhash64(F.lit(seed), *[F.element_at(lines, i + k) for k in range(WINDOW)]).alias("b"),
                F.length(F.concat(*[F.trim(F.translate(F.element_at(lines, i + k), "\t\r\x0b\x0c", "    ")) for k in range(WINDOW)])).alias("n"),
            ),
        )

    lines = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_w_doc"), F.split("text", "\n", -1).alias("_w_lines"))
    lines = lines.filter(F.size("_w_lines") >= WINDOW)
    each = lines.select("_w_doc", F.posexplode(keys(F.col("_w_lines"), 7)).alias("_w_at", "_w_k"))
    return each.filter("_w_k.n > 0").select(F.col("_w_k.a").alias("_w_a"), F.col("_w_k.b").alias("_w_b"), "_w_doc", "_w_at")


def repeated(docs: DataFrame) -> DataFrame:
    """The windows to remove: _w_doc, _w_at of all but the first of each key.

    Keys are counted with a partial aggregate per task, so a window that stands
    in a third of all documents leaves each task once; the join back on the few
    repeated keys is one that Spark can split when a key is hot."""
    found = staged(windows(docs), "windows")
    place = F.struct("_w_doc", "_w_at")
    many = found.groupBy("_w_a", "_w_b").agg(F.count(F.lit(1)).alias("_w_n"), F.min(place).alias("_w_first"))
    many = many.filter("_w_n > 1").drop("_w_n")
    again = found.join(many, ["_w_a", "_w_b"])
    return again.filter(~F.struct("_w_doc", "_w_at").eqNullSafe(F.col("_w_first"))).select("_w_doc", "_w_at").distinct()


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``; two columns more,
    n_lines (before) and n_removed."""
    if bad := [c for c in docs.columns if c.startswith("_w_")]:
        raise ValueError(f"columns {bad} are reserved")
    cover = repeated(docs).groupBy("_w_doc").agg(F.sort_array(F.collect_list("_w_at")).alias("_w_starts"))
    cover = cover.select(F.col("_w_doc.doc_id").alias("_w_id"), F.col("_w_doc.h").alias("_w_h"), "_w_starts")
    keyed = docs.withColumn("_w_hash", F.xxhash64("text"))
    joined = keyed.join(cover, F.col("doc_id").eqNullSafe(F.col("_w_id")) & (F.col("_w_hash") == F.col("_w_h")), "left")
    cut = F.pandas_udf(_without, "string")(F.col("text"), F.col("_w_starts"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    covered = F.array_distinct(F.flatten(F.transform("_w_starts", lambda s: F.array(*[s + k for k in range(WINDOW)]))))
    return joined.select(
        *[F.when(F.col("_w_starts").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_removed"),
    )
