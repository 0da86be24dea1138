"""Encoding (E1-E4) and column-order restoration.

E1/E2: string columns become float codes in sorted category order and back.
The dictionary (distinct values with their rank) is built distributed: the
distinct values are range-partitioned, ranked per range and offset by a
bounded table of range counts, then checkpointed so every later join sees the
same codes.  Whether the dictionary is broadcast is left to Spark's check of its size
in bytes; over ``broadcast_rows`` rows the join always shuffles.  Null values
have a null code and null codes decode to null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltspark.operators.positions import value_position
from quiltspark.session import materialize

BROADCAST_ROWS = 1_000_000


def _q(c: str):
    return F.col(f"`{c}`")


class OrdinalEncoder:
    """E1/E2 over the string columns of a table (sorted category order, float codes).

    Unseen categories at transform time get a null code (reference defect D10
    refits on holdout data; we reuse the training dictionary).
    """

    def __init__(self, columns: Sequence[str] | None = None, broadcast_rows: int = BROADCAST_ROWS):
        self.columns = list(columns) if columns is not None else None
        self.broadcast_rows = broadcast_rows
        self.dictionaries: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}

    def fit(self, df: DataFrame) -> "OrdinalEncoder":
        if self.columns is None:
            self.columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        for c in self.columns:
            distinct = df.select(_q(c).alias("__v")).where(F.col("__v").isNotNull()).distinct()
            ranked = value_position(distinct, ["__v"], out="__code").select(
                "__v", F.col("__code").cast("double").alias("__code")
            )
            self.dictionaries[c] = materialize(ranked, f"dict-{c}")
            self.sizes[c] = self.dictionaries[c].count()
        return self

    def _dict(self, c: str) -> DataFrame:
        d = self.dictionaries[c]
        # Spark broadcasts by its own check of the size in bytes; the row bound only keeps long dictionaries from it
        return d if self.sizes[c] <= self.broadcast_rows else d.hint("merge")

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.columns:
            if c not in df.columns:
                continue
            d = self._dict(c).withColumnRenamed("__v", "__enc_v").withColumnRenamed("__code", "__enc_code")
            out = out.join(d, _q(c) == F.col("__enc_v"), "left").drop(c, "__enc_v").withColumnRenamed("__enc_code", c)
        return out.select(*[_q(c) for c in df.columns])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Clamp codes to ``[0, k-1]``, round, map back to the category."""
        out = df
        for c in self.columns:
            if c not in df.columns:
                continue
            k = self.sizes[c]
            # greatest and least skip nulls: a null code (null or unseen value) stays null
            clamped = F.least(F.greatest(F.round(_q(c)), F.lit(0.0)), F.lit(float(max(k - 1, 0))))
            code = F.when(_q(c).isNotNull() & ~F.isnan(_q(c).cast("double")), clamped)
            d = self._dict(c).withColumnRenamed("__v", "__dec_v").withColumnRenamed("__code", "__dec_code")
            out = (
                out.withColumn("__dec_key", code)
                .join(d, F.col("__dec_key") == F.col("__dec_code"), "left")
                .drop(c, "__dec_key", "__dec_code")
                .withColumnRenamed("__dec_v", c)
            )
        return out.select(*[_q(c) for c in df.columns])


def restore_column_order(df: DataFrame, original_columns: Sequence[str]) -> DataFrame:
    """The generated table in the training table's column order."""
    return df.select(*[_q(c) for c in original_columns])


def to_numeric(df: DataFrame) -> DataFrame:
    """Type rule: booleans to int, timestamps/dates to epoch seconds, decimals to double."""
    cols = []
    for f in df.schema.fields:
        c = _q(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_timestamp(c).cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.unix_timestamp(c.cast("timestamp")).cast("double")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def scaler(kind: str, input_col: str = "features", output_col: str = "scaled"):
    """Scalers used ahead of a classifier (minmax, standard, robust, quantile)."""
    from pyspark.ml import feature as Fe

    if kind == "minmax":
        return Fe.MinMaxScaler(inputCol=input_col, outputCol=output_col)
    if kind == "standard":
        return Fe.StandardScaler(inputCol=input_col, outputCol=output_col, withMean=True, withStd=True)
    if kind == "robust":
        return Fe.RobustScaler(inputCol=input_col, outputCol=output_col)
    raise ValueError(f"unknown scaler {kind!r}; for quantile use quantile_transform()")


def quantile_transform(df: DataFrame, cols: Sequence[str], n_quantiles: int = 250, relative_error: float = 1e-4):
    """E4 quantile transform: ``approxQuantile`` cut points, then the bucket index / (n-1)."""
    from pyspark.ml.feature import QuantileDiscretizer

    qd = QuantileDiscretizer(
        numBuckets=n_quantiles, inputCols=list(cols), outputCols=[f"{c}__q" for c in cols],
        relativeError=relative_error, handleInvalid="keep",
    ).fit(df)
    out = qd.transform(df)
    for c, splits in zip(cols, qd.getSplitsArray()):
        nb = max(len(splits) - 2, 1)
        out = out.withColumn(c, F.col(f"{c}__q") / F.lit(float(nb))).drop(f"{c}__q")
    return out
