"""Distributed positional primitives.

A Spark DataFrame has no row order, but the reference's operators are
positional.  Everything here gives exact positions / order statistics without
funnelling rows through one task:

* :func:`dense_position` -- 0-based rank in md5-key order.  Keys are uniform,
  so the first hex digits cut the table into equally sized buckets; a window per
  bucket ranks locally and a bounded table of bucket offsets (at most
  ``16**digits`` rows) is broadcast to make the rank global.
* :func:`kth_value` -- exact k-th order statistic by iterative bucket
  refinement: each pass is a scan plus a <= 4096-group partial aggregate; only
  a final bucket of at most ``max_collect`` values is ever sorted.
* :func:`value_position` / :func:`cumulative_sum` -- rank / running sum in
  *value* order: the table is dealt by ranges of the whole order tuple, as many as
  its rows ask for, sorted and numbered there; a row per range holds the offset.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltspark.session import materialize


COPIES_AT_ONCE = 100_000
#: Rows of a slice of an ordered table, and how many slices there are at most.
ROWS_PER_SLICE, MAX_SLICES = 100_000, 32_768


def bucket_digits(n_rows: int | None, rows_per_bucket: int = 2_000_000) -> int:
    """Hex digits so that a bucket holds about ``rows_per_bucket`` rows (2..5)."""
    if not n_rows or n_rows <= 0:
        return 3
    need = max(1.0, n_rows / rows_per_bucket)
    return int(min(5, max(2, math.ceil(math.log(need, 16)))))


def dense_position(
    df: DataFrame,
    key: Column,
    tiebreak: str,
    out: str = "__pos",
    n_rows: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Add ``out``: 0-based position of each row in ``(key, tiebreak)`` order.

    ``key`` must be a hex string (md5).  Equivalent to
    ``row_number() over (order by key, tiebreak) - 1`` but without a global
    single-partition window.
    """
    d = digits or bucket_digits(n_rows)
    keyed = df.withColumn("__k", key).withColumn("__b", F.conv(F.substring("__k", 1, d), 16, 10).cast("int"))
    counts = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16**d rows (<= 1,048,576): proven small, broadcast
    offsets = counts.select("__b", F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy("__b").orderBy("__k", tiebreak)
    return (
        keyed.join(F.broadcast(offsets), "__b")
        .withColumn(out, (F.col("__off") + F.row_number().over(w_in) - F.lit(1)).cast("long"))
        .drop("__k", "__b", "__off")
    )


def kth_value(
    df: DataFrame,
    col: str,
    k: int,
    descending: bool = False,
    max_collect: int = 50_000,
    buckets: int = 4096,
    weight: str | None = None,
):
    """Exact value at 0-based index ``k`` of ``col`` sorted (nulls ignored, NaN above all numbers).

    Matches ``ORDER BY col [DESC] LIMIT 1 OFFSET k``.  With ``weight`` a row counts
    as so many rows.  Returns None when k is out of range.
    """
    # one column, reused by every pass; recomputation after a lost block is
    # deterministic, so a plain persist is safe here
    w = F.lit(1) if weight is None else F.col(weight)
    x = df.select(F.col(col).alias("x"), w.cast("long").alias("w")).where(F.col("x").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _kth(x, k, descending, max_collect, buckets)
    finally:
        x.unpersist()


def _kth(x: DataFrame, k: int, descending: bool, max_collect: int, buckets: int):
    real = dict(x.dtypes)["x"] in ("double", "float")
    usual = ~F.isnan("x") if real else F.lit(True)
    row = x.agg(F.sum("w").alias("n"), F.sum(F.when(usual, F.col("w"))).alias("numbers"),
                F.min(F.when(usual, F.col("x"))).alias("lo"), F.max(F.when(usual, F.col("x"))).alias("hi")).first()
    n, numbers, lo, hi = row["n"] or 0, row["numbers"] or 0, row["lo"], row["hi"]
    if k < 0 or k >= n:
        return None
    target = (n - 1 - k) if descending else k  # ascending index
    if target >= numbers:
        return float("nan")
    if real and (lo == float("-inf") or hi == float("inf")):  # infinities are counted apart, as NaN is
        ends = x.where(F.abs("x") < float("inf")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("n")).first()
        low = x.where(F.col("x") == float("-inf")).agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
        if target < low:
            return float("-inf")
        if target >= low + (ends["n"] or 0):
            return float("inf")
        target, lo, hi, numbers = target - low, ends["lo"], ends["hi"], ends["n"]
    in_range = numbers
    while in_range > max_collect and lo < hi:
        if real:  # no difference that could overflow
            width = float(hi) / buckets - float(lo) / buckets
            if width <= 0:
                break  # fewer than ``buckets`` different numbers are left
            place = F.col("x").cast("double") / F.lit(width) - F.lit(float(lo) / width)
            if not abs(float(lo) / width) < 2**52:
                place = (F.col("x").cast("double") - F.lit(float(lo))) / F.lit(width)
        else:
            width = float(hi - lo) / buckets
            # subtract in the column's own type (exact for 60-bit integer keys), then scale
            place = (F.col("x") - F.lit(lo)).cast("double") / F.lit(width)
        b = F.greatest(F.lit(0), F.least(F.floor(place), F.lit(buckets - 1))).cast("int")
        stats = (
            x.where((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi)))
            .groupBy(b.alias("b"))
            .agg(F.sum("w").alias("c"), F.min("x").alias("mn"), F.max("x").alias("mx"))
            .collect()  # <= `buckets` rows
        )
        stats.sort(key=lambda r: r["mn"])
        before = (lo, hi)
        for r in stats:
            if target < r["c"]:
                lo, hi, in_range = r["mn"], r["mx"], r["c"]
                break
            target -= r["c"]
        if (lo, hi) == before:
            break
    if lo == hi:
        return lo
    # a row per value: no more than ``max_collect`` of them, or than the range has numbers
    values = x.where((F.col("x") >= F.lit(lo)) & (F.col("x") <= F.lit(hi))).groupBy("x").agg(F.sum("w").alias("c"))
    if in_range > max_collect and (found := values.count()) > max_collect:
        raise ArithmeticError(f"{found} values between {lo} and {hi} could not be told apart")
    for r in sorted(values.collect(), key=lambda r: r["x"]):
        if target < r["c"]:
            return r["x"]
        target -= r["c"]
    return hi


def _nulls_last(order_cols: list[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order_cols]


def slices_for(n_rows: int) -> int:
    """Into how many slices so many rows go."""
    return max(1, min(MAX_SLICES, -(-n_rows // ROWS_PER_SLICE)))


def sliced_in_order(df: DataFrame, order_cols: list[str], slices: int | None = None) -> DataFrame:
    """``df`` dealt by ranges of the whole order tuple, with ``__slice`` (the range) and
    ``__at`` (the row's number in it, in order; nulls last).

    The ranges are cut on the tuple, which ends with a unique column, so rows that share
    the first value, however many, go to as many slices as their number asks for.  One
    shuffle; the result is written, so every later plan sees the same ranges."""
    n = slices or slices_for(df.count())
    order = _nulls_last(order_cols)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition, the lower 33 the row in it
    numbered = ranged.withColumn("__at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__slice", F.shiftright("__at", 33).cast("int"))
    return materialize(numbered.withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))), "slices")


def _with_offsets(sliced: DataFrame, total: Column, part: list[str], few_groups: bool = False) -> DataFrame:
    """``sliced`` with ``__first`` (the group's first row in the slice) and ``__off`` (``total``
    over the group's earlier slices).  The joined table has a row per slice and group in it:
    as groups follow each other, no more than slices and groups together."""
    before = Window.partitionBy(*part).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("__slice", *part).agg(total.alias("__tot"), F.min("__at").alias("__first"))
    sums = sums.withColumn("__off", F.coalesce(F.sum("__tot").over(before), F.lit(0))).drop("__tot")
    if not part:
        return sliced.join(F.broadcast(sums), "__slice")  # a row per slice
    named = sums.select(F.col(part[0]).alias("__g"), F.col("__slice").alias("__s"), "__first", "__off")
    named = F.broadcast(named) if few_groups else named
    return sliced.join(named, (F.col("__slice") == F.col("__s")) & F.col(part[0]).eqNullSafe(F.col("__g"))).drop("__g", "__s")


def value_position(
    df: DataFrame,
    order_cols: list[str],
    out: str = "__pos",
    partition_col: str | None = None,
    ranges: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``out``: 0-based position in ``order_cols`` order (value order).

    Rows are numbered within ranges of the whole order (:func:`sliced_in_order`); a
    small table of range offsets makes the number global.  Nulls rank last.
    ``order_cols`` must be a total order (end with a unique column).  With
    ``partition_col`` the rank restarts for every value of that column, null included;
    ``few_groups`` says that it has few values, whose offsets may be broadcast.
    """
    part = [partition_col] if partition_col else []
    sliced = sliced_in_order(df, [*part, *order_cols], ranges)
    placed = _with_offsets(sliced, F.count(F.lit(1)), part, few_groups)
    position = F.col("__off") + F.col("__at") - (F.col("__first") if part else F.lit(0))
    return placed.withColumn(out, position.cast("long")).drop("__slice", "__at", "__first", "__off")


def with_dense_id(df: DataFrame, seed: int = 0, out: str = "__row_id") -> DataFrame:
    """Dense 0..n-1 id for a table without one: rank by md5 of the whole row and its copy number.

    Identical rows are counted (a partial aggregate per task) and written out again
    with the number of the copy, which is part of the key: copies of one row
    spread over all buckets, and the ids depend on the rows alone, not on how
    they are laid out.
    """
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("␀")) for c in df.columns]
    n = df.count()
    some = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    some = some.withColumn("__c", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES_AT_ONCE))))
    first = F.col("__c") * F.lit(COPIES_AT_ONCE)
    some = some.withColumn("__copy", F.explode(F.sequence(first, F.least(F.col("__n") - 1, first + F.lit(COPIES_AT_ONCE - 1)))))
    some = some.drop("__n", "__c")
    key = F.md5(F.concat_ws("␟", F.lit(str(seed)), *cols, F.col("__copy").cast("string")))
    return dense_position(some, key, "__copy", out=out, n_rows=n).drop("__copy")


def cumulative_sum(
    df: DataFrame,
    order_cols: list[str],
    value_col: str,
    out: str,
    partition_col: str | None = None,
    inclusive: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``: running sum of ``value_col`` in ``order_cols`` order.

    Same slicing as :func:`value_position`: per-slice totals (a bounded table)
    give each slice its starting offset, a window inside the slice does the
    rest.  ``inclusive=False`` excludes the row itself.
    """
    part = [partition_col] if partition_col else []
    sliced = sliced_in_order(df, [*part, *order_cols], ranges)
    end = 0 if inclusive else -1
    inside = Window.partitionBy("__slice", *part).orderBy("__at").rowsBetween(Window.unboundedPreceding, end)
    return (
        _with_offsets(sliced, F.sum(value_col), part)
        .withColumn(out, F.col("__off") + F.coalesce(F.sum(value_col).over(inside), F.lit(0)))
        .drop("__slice", "__at", "__first", "__off")
    )
