"""Privacy metrics by exact nearest neighbours: U4 distance to the closest record,
U5 identifiability risk.

Both measure rows with the mixed distance of :mod:`quiltspark.operators.nearest`.
Nulls are values (equal to each other only); equal rows are each other's nearest
at distance 0; ties are no matter, only distances count.  Where a table has no
(other) row to be near to, its rows are left out; without any, the figure is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltspark.operators.nearest import Space, nearest_distances, neighbours, own_nearest_distances
from quiltspark.operators.positions import kth_value
from quiltspark.session import materialize

#: Distances are compared after rounding to so many places.
DIGITS = 9


def weighted_median(df: DataFrame, value: str, rows: str) -> float | None:
    """The exact median of ``value`` where a row stands for ``rows`` rows."""
    total = df.where(F.col(value).isNotNull()).agg(F.sum(rows)).first()[0] or 0
    if not total:
        return None
    low = kth_value(df, value, (total - 1) // 2, weight=rows)
    high = low if total % 2 else kth_value(df, value, total // 2, weight=rows)
    return (low + high) / 2


def median_dcr(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, float | None]:
    """U4: the median distance of a synthetic row to the nearest real one, the median
    distance of a real row to the nearest other one, and their ratio (null if that is 0)."""
    space = Space.of(real, numeric, categorical)
    to_real = weighted_median(materialize(nearest_distances(synthetic, real, space), "dcr-synthetic"), "d", "n")
    own = weighted_median(materialize(own_nearest_distances(real, space).select("d", "n"), "dcr-real"), "d", "n")
    ratio = to_real / own if own and to_real is not None else None
    return {"median_synthetic": to_real, "median_real": own, "median_dcr": ratio}


def inverse_entropies(real: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """1 / H of each column's values (natural logarithm, null is a value); 0 for a constant column."""
    parts = None
    for c in columns:
        counts = real.groupBy(F.col(f"`{c}`")).agg(F.count(F.lit(1)).alias("n"))
        h = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
        one = counts.agg(F.lit(c).alias("column"), h.alias("h"), F.count(F.lit(1)).alias("values"))
        parts = one if parts is None else parts.unionByName(one)
    return {r["column"]: 1.0 / r["h"] if r["values"] > 1 else 0.0 for r in parts.collect()}  # a row per column


def identifiability(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Per distinct real row: n (rows), own (distance to the nearest other real row),
    at_risk (whether a synthetic row is nearer).

    The own distance is the radius of the search among the synthetic rows."""
    space = Space.of(real, numeric, categorical, inverse_entropies(real, [*numeric, *categorical]))
    own = materialize(own_nearest_distances(real, space), "own-distances")
    asked = own.where("d > 0").withColumnRenamed("d", "radius")
    found = neighbours(asked, space.points(synthetic), space).select("q", F.col("d").alias("near"))
    nearer = F.round("near", DIGITS) < F.round("d", DIGITS)
    return own.join(found, "q", "left").select("n", F.col("d").alias("own"), F.coalesce(nearer, F.lit(False)).alias("at_risk"))


def identifiability_risk(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> float | None:
    """The share of real rows whose nearest synthetic row is nearer than the nearest other real row."""
    rows = identifiability(real, synthetic, numeric, categorical)
    return rows.agg(F.sum(F.when(F.col("at_risk"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]


def privacy_loss(train: DataFrame, holdout: DataFrame, synthetic: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, float | None]:
    """U5 for the training rows, and how much more that is than for rows the generator never saw."""
    risk, other = (identifiability_risk(t, synthetic, numeric, categorical) for t in (train, holdout))
    return {"eps_identif_risk": risk, "priv_loss_eps": None if risk is None or other is None else risk - other}
