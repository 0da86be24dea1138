"""Aggregations (A1, A2, A4, A6-A9, P8) and reshaping of result tables.

All are grouped aggregates with map-side partial aggregation; none needs
rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _q(c: str):
    return F.col(f"`{c}`")


def mean_sem(long_df: DataFrame, keys: Sequence[str] = ("metric",), value: str = "value", digits: int = 6) -> DataFrame:
    """A1: mean and standard error (``stddev_samp / sqrt(n)``) per key."""
    return long_df.groupBy(*keys).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value) / F.sqrt(F.count(value)), digits).alias("sem"),
    )


def timing_mean_sem(runs: DataFrame, metric_keys: Sequence[str] = ("metric",), time_col: str = "time",
                    value: str = "value", digits: int = 6) -> DataFrame:
    """A2: A1 of the metrics plus a ``time`` row from the runs' wall times."""
    base = mean_sem(runs, metric_keys, value, digits)
    times = runs.select("rep", time_col).distinct().select(F.lit("time").alias(metric_keys[0]), F.col(time_col).alias(value))
    return base.unionByName(mean_sem(times, metric_keys[:1], value, digits), allowMissingColumns=True)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4: exact distinct count per column (nulls left out), as ``(column, n_distinct)``.

    One branch per column, which reads that column alone: together they read a columnar
    table once, each task hands on a value once, and no row is copied for other columns."""
    out = None
    for c in cols:
        values = df.select(_q(c).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.lit(1).alias("one"))
        one = values.agg(F.count(F.lit(1)).cast("long").alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct")
        out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], "column string, n_distinct long") if out is None else out


def classify_columns(df: DataFrame, max_levels: int = 5) -> DataFrame:
    """categorical = string columns and numeric columns with <= ``max_levels`` values."""
    cols = df.columns
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    counts = distinct_counts(df, cols)
    return counts.withColumn(
        "kind",
        F.when(F.col("column").isin(list(strings)) | (F.col("n_distinct") <= max_levels), F.lit("categorical")).otherwise(
            F.lit("numeric")
        ),
    )


def tag_real_synthetic(real: DataFrame, synthetic: DataFrame, label: str = "data") -> DataFrame:
    """Stack real and synthetic rows with a label column."""
    return real.withColumn(label, F.lit("Real")).unionByName(synthetic.withColumn(label, F.lit("Synthetic")))


def attribute_histogram(real: DataFrame, synthetic: DataFrame, discrete: Sequence[str], continuous: Sequence[str],
                        bins: int = 10, digits: int = 6) -> DataFrame:
    """Per attribute and data set the share of rows per value / equal-width bin.

    Continuous attributes use ``bins`` equal bins of the pooled (real+synthetic)
    range; shares are normalised within (attribute, data).  Nulls are a bucket of
    their own (null), so the shares of a pair add up to 1.
    """
    both = tag_real_synthetic(real.select(*discrete, *continuous), synthetic.select(*discrete, *continuous))
    pieces = []
    if continuous:
        rng = both.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(continuous)],
                       *[F.max(c).alias(f"hi{i}") for i, c in enumerate(continuous)]).first()
        for i, c in enumerate(continuous):
            lo, hi = float(rng[f"lo{i}"] or 0), float(rng[f"hi{i}"] or 0)
            width = (hi - lo) / bins if hi > lo else 1.0
            b = F.least(F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
            b = F.when(F.col(c).isNotNull(), b)
            pieces.append(both.select(F.lit(c).alias("attribute"), "data", b.cast("string").alias("bucket")))
    for c in discrete:
        pieces.append(both.select(F.lit(c).alias("attribute"), "data", F.col(c).cast("string").alias("bucket")))
    long = pieces[0]
    for p in pieces[1:]:
        long = long.unionByName(p)
    counts = long.groupBy("attribute", "data", "bucket").agg(F.count(F.lit(1)).alias("n"))
    totals = long.groupBy("attribute", "data").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, ["attribute", "data"]).select(
        "attribute", "data", "bucket", F.round(F.col("n") / F.col("total"), digits).alias("share")
    )


def probability_histogram(df: DataFrame, prob: str = "score", bins: int = 20) -> DataFrame:
    """Counts of a probability in ``bins`` equal bins of [0, 1] (1.0 in the last bin, nulls in a null bin)."""
    b = F.when(F.col(prob).isNotNull(), F.least(F.floor(F.col(prob) * F.lit(bins)), F.lit(bins - 1))).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibration_curve(df: DataFrame, prob: str = "score", label: str = "label", bins: int = 10,
                      digits: int = 6) -> DataFrame:
    """Per uniform bin (edges inclusive on the right, as a sorted search would place
    them) the mean predicted probability, the fraction of positives and the count."""
    b = F.least(F.greatest(F.ceil(F.col(prob) * F.lit(bins)) - F.lit(1), F.lit(0)), F.lit(bins - 1)).cast("int")
    b = F.when(F.col(prob).isNotNull(), b)
    return df.groupBy(b.alias("bin")).agg(
        F.round(F.avg(prob), digits).alias("mean_pred"),
        F.round(F.avg(F.col(label).cast("double")), digits).alias("frac_pos"),
        F.count(F.lit(1)).alias("n"),
    )


def calibration_pair(train: DataFrame, holdout: DataFrame, prob: str = "score", label: str = "label", bins: int = 10,
                     digits: int = 6) -> DataFrame:
    """A8 side by side: the curve and its histogram for the training set (``k`` = 1) and the holdout set (``k`` = 2)."""
    sides = [calibration_curve(df, prob, label, bins, digits).select(F.lit(k).alias("k"), "*") for k, df in ((1, train), (2, holdout))]
    return sides[0].unionByName(sides[1])


def group_point_estimates(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, sample sd and sem per group (the data behind the figures)."""
    return df.groupBy(*keys).agg(
        F.round(F.avg(value), digits).alias("mean"),
        F.round(F.stddev_samp(value), digits).alias("sd"),
        F.round(F.stddev_samp(value) / F.sqrt(F.count(value)), digits).alias("sem"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics_to_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """P5: wide run results to ``(ids..., metric, value)``."""
    return wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value"
    )


def filter_log(log_df: DataFrame, equals: Mapping[str, object] | None = None,
               isin: Mapping[str, Sequence] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Filter an experiment log on key columns, then drop them."""
    out = log_df
    for k, v in (equals or {}).items():
        out = out.where(F.col(k) == F.lit(v))
    for k, vs in (isin or {}).items():
        out = out.where(F.col(k).isin(list(vs)))
    return out.drop(*drop)


def derive_ratio(df: DataFrame, num: str, den: str, out: str = "ratio", digits: int = 6) -> DataFrame:
    """``num / den`` (null when the denominator is 0)."""
    return df.withColumn(out, F.round(F.try_divide(F.col(num), F.col(den)), digits))


def binarize(df: DataFrame, col: str, threshold: float = 0.0, out: str | None = None) -> DataFrame:
    """``col <= threshold`` as 0/1."""
    return df.withColumn(out or col, (F.col(col) <= F.lit(threshold)).cast("int"))


def stack_rows(*dfs: DataFrame) -> DataFrame:
    """Row-wise concatenation by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def complement(full: DataFrame, subset: DataFrame, key: str) -> DataFrame:
    """Rows of ``full`` whose key is not in ``subset``."""
    return full.join(subset.select(key), key, "left_anti")
