"""Operator 7: best-fit packing by linear grouping.

Documents become pieces of at most ``cap`` ids (only longer ones are cut, the
last piece may be shorter).  The histogram of piece lengths, at most ``cap``
rows whatever the input, goes to the driver; ``packplan.plan`` turns it into
runs of places.  Each piece then finds its place by its rank among the pieces
of its length.  A length that a third of all pieces share is ranked in about
sqrt(count) buckets, so neither a bucket nor the list of buckets gets large.

A null or empty text is one piece of the end id alone.  Repeated rows are
packed each by itself.  Null ids are kept.  Ties (equal length) are ordered by
the pieces' own columns.  An empty table gives no rows.  ``pieces`` reads the
two named columns only, so other names cannot clash; ``place`` keeps any
columns but refuses names starting with ``_p_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packplan
from .common import staged
from .wordcode import encoder

PIECE = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, cap: int) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian u32) of every whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, keeps_space=False)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for key, blob in zip(some.column("doc_id").to_pylist(), code.encode(some.column("text").to_pylist()), strict=True):
                    ids = np.concatenate([np.frombuffer(blob, code.kind), end]).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), cap)):
                        part = ids[a : a + cap]
                        for column, x in zip(rows, (key, k, a, len(part), part.tobytes()), strict=True):
                            column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def place(parts: DataFrame, cap: int) -> DataFrame:
    """``parts`` (any columns, ``length`` from 1 to ``cap``) with sequence_id and offset."""
    if bad := [c for c in parts.columns if c.startswith("_p_") or c in ("sequence_id", "offset")]:
        raise ValueError(f"columns {bad} are reserved")
    parts = staged(parts, "pieces")
    spark = parts.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < length <= cap for length in hist):
        raise ValueError(f"lengths must be 1 to {cap}")
    runs = sorted(packplan.plan(hist, cap))
    kind = T.StructType([T.StructField("length", T.LongType()), T.StructField("_p_buckets", T.LongType())])
    buckets = spark.createDataFrame([(length, int(np.ceil(np.sqrt(n)))) for length, n in hist.items()], kind)
    own = [c for c in parts.columns if c != "length"]
    keyed = parts.join(F.broadcast(buckets), "length")  # at most cap rows
    keyed = keyed.withColumn("_p_bucket", F.pmod(F.xxhash64(*own), F.col("_p_buckets"))).drop("_p_buckets")
    sizes = keyed.groupBy("length", "_p_bucket").agg(F.count(F.lit(1)).alias("_p_n"))
    before = F.sum("_p_n").over(Window.partitionBy("length").orderBy("_p_bucket")) - F.col("_p_n")
    sizes = sizes.select("length", "_p_bucket", before.alias("_p_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_p_bucket").orderBy(*own))
    ranked = keyed.withColumn("_p_row", inside).join(sizes, ["length", "_p_bucket"])
    ranked = ranked.withColumn("_p_rank", F.col("_p_before") + F.col("_p_row") - 1).select(*parts.columns, "_p_rank")
    table = np.array(runs, np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 48) + table[:, 1]
    names = parts.columns
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_p_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            into, each = rank - run[:, 1], np.maximum(run[:, 4], 1)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(run[:, 3] + into // each), pa.array(run[:, 5] + into % each * length)], [*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(put, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the ids of each sequence put together in place order
    (``placed`` must carry ``ids``; a sequence holds at most ``cap`` ids)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    packed = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("_s"))
    joined = F.aggregate("_s", F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x["ids"]))
    return packed.select("sequence_id", "n_tokens", joined.alias("ids"))
