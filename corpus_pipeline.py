"""A training-corpus pipeline of four stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows to the shared checkpoint folder as Parquet and gives the next
stage what it reads back.  All stages but the last return the columns of
``documents``.  Null and empty texts are clean, have no lines to lose and no near
duplicates, and are packed as the end id alone.  Empty tables give an empty result;
without labelled rows no document is rejected.  Repeated rows: see the third stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltspark.llm import jaccardjoin, linededup, packing, toxicity
from quiltspark.llm.common import staged, table
from quiltspark.llm.registry import PACK_CAP, PACK_END


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line passages; ``n_chars`` follows the text
    where lines were removed.  Every document stays, even one left without text."""
    cut = linededup.remove_repeated_lines(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id.

    Where ids repeat, each row is a document of its own: of rows with one id and unlike
    texts all stay, of near duplicates with one id any one.  Rows without an id stay."""
    named = docs.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        gone = jaccardjoin.near_duplicates(docs).filter("component_id < doc_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if "_row" in docs.columns:
        raise ValueError("the column _row is reserved")
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")  # a number that stays
    of = rows.filter("doc_id is not null").select(F.col("_row").alias("_r"), F.col("doc_id").alias("_id"), "text")
    found = jaccardjoin.near_duplicates(of.select(F.col("_r").alias("doc_id"), "text"))
    found = found.filter("n_shingles > 0").join(of.select("_r", "_id"), F.col("doc_id") == F.col("_r")).select("_r", "_id", "component_id")
    first = found.groupBy("component_id").agg(F.min(F.struct("_id", "_r")).alias("_first"))
    gone = found.join(first, "component_id").filter("_r <> _first._r").select(F.col("_r").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), PACK_END, PACK_CAP)
    parts = parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(parts, PACK_CAP).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: The fitted model and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
