"""Sources and sinks.

Files go to shared storage only: scratch output lives under the cluster's
``spark.checkpoint.dir`` (see :mod:`quiltspark.session`), never a
machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltspark.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/quiltspark-io/{name}-{uuid.uuid4().hex[:12]}"


def scan_csv(spark: SparkSession, path: str, schema=None, drop_nulls: bool = True) -> DataFrame:
    """CSV with a header; an explicit schema where known (inference is a full extra pass)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.na.drop() if drop_nulls else df


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: write without an index column, with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def append_result_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Create the log if absent, else append (Spark's commit protocol makes
    concurrent appends from several jobs safe, unlike appending to one CSV)."""
    df.write.mode("append").format(fmt).save(path)


def write_splits(spark: SparkSession, splits: Mapping[str, Sequence[str]], path: str) -> None:
    """Save a column split as one JSON object."""
    spark.createDataFrame([(json.dumps({k: list(v) for k, v in splits.items()}),)], "value string").coalesce(
        1
    ).write.mode("overwrite").text(path)


def read_splits(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Load a column split saved by :func:`write_splits` (or a JSON file of the same shape)."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return {k: list(v) for k, v in json.loads(text).items()}


def load_and_union(spark: SparkSession, base_path: str, reader=None) -> DataFrame:
    """Read ``<base>_train`` and ``<base>_test`` and stack them; without both, ``<base>`` alone."""
    reader = reader or (lambda p: spark.read.parquet(p))
    both = [f"{base_path}_train", f"{base_path}_test"]
    if all(exists(spark, p) for p in both):
        return reader(both[0]).unionByName(reader(both[1]))
    return reader(base_path)


def read_result_sets(result_sets: Mapping[str, DataFrame], value: str = "mean", metric: str = "metric") -> DataFrame:
    """Stack result tables with a ``model`` literal, then pivot models to columns."""
    models = list(result_sets)
    stacked = None
    for m, df in result_sets.items():
        piece = df.select(F.lit(m).alias("model"), metric, value)
        stacked = piece if stacked is None else stacked.unionByName(piece)
    return stacked.groupBy(metric).pivot("model", models).agg(F.first(value))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


__all__ = [
    "append_result_log",
    "exists",
    "load_and_union",
    "read_result_sets",
    "read_splits",
    "scan_csv",
    "scratch_path",
    "sink_csv",
    "write_splits",
]
