"""Loading the benchmark tables as split-able inputs.

``orders`` has a dense unique key (``o_orderkey`` = 0..n-1), so it is used
directly as ``__row_id``.  Column pruning is left to Catalyst: every reader
returns a lazy projection of the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "__row_id"

# The flagship column split of ``orders`` (step 0 of the build plan).
ORDERS_SPLITS = {
    "split0": ["o_orderstatus", "o_totalprice"],
    "split1": ["o_custkey", "o_orderpriority"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias(ROW_ID), *[c for c in o.columns if c != "o_orderkey"])


def orders_parts(spark: SparkSession, sf_dir: str, splits=None) -> dict[str, DataFrame]:
    """P1 on ``orders``: one ``(__row_id, cols...)`` projection per split."""
    base = orders_with_id(spark, sf_dir)
    splits = splits or ORDERS_SPLITS
    return {name: base.select(ROW_ID, *cols) for name, cols in splits.items()}
