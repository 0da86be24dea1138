"""Column splits and correlation-driven splitting.

The only data-sized work is the correlation matrix (A3): all pairwise
moments in one aggregate pass (map-side partial aggregation, one tiny
shuffle).  Deciding a split is schema-level: a greedy loop over the d x d
result on the driver (d = number of columns, not rows).
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Mapping, Sequence
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID = "__row_id"
PAIRS_PER_AGG = 300  # keeps generated aggregate code under the JVM method-size limit


def _q(c: str):
    return F.col(f"`{c}`")


def _pairwise_r(a: str, b: str):
    """Pearson r over the rows where both columns hold a value; 0 without variance there."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    """Pearson r for every unordered pair over its complete rows, zero-variance pairs give 0.

    ``coalesce(try_divide(covar_pop, stddev_pop*stddev_pop), 0)``: ANSI mode
    raises on ``corr`` of a constant column, so the ratio is spelled out.
    Pairs are chunked so wide tables stay inside codegen limits.
    """
    cols = list(cols)
    pairs = list(combinations(range(len(cols)), 2))
    out: dict[tuple[str, str], float] = {}
    x = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    for start in range(0, len(pairs), PAIRS_PER_AGG):
        chunk = pairs[start : start + PAIRS_PER_AGG]
        exprs = [_pairwise_r(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i, j in chunk]
        row = x.agg(*exprs).first()
        for i, j in chunk:
            v = row[f"r_{i}_{j}"]
            out[(cols[i], cols[j])] = 0.0 if v is None or v != v else float(v)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str], absolute: bool = True, zero_diagonal: bool = True):
    """A3 on the driver side: d x d numpy matrix (abs, NaN to 0, diagonal 0)."""
    cols = list(cols)
    r = pair_correlations(df, cols)
    m = np.zeros((len(cols), len(cols)))
    for (a, b), v in r.items():
        i, j = cols.index(a), cols.index(b)
        m[i, j] = m[j, i] = abs(v) if absolute else v
    if not zero_diagonal:
        np.fill_diagonal(m, 1.0)
    return m


def correlation_long(df: DataFrame, cols: Sequence[str], absolute: bool = True) -> DataFrame:
    """A3 as a DataFrame ``(col_a, col_b, r)`` over all ordered pairs, diagonal 0.

    One aggregate per ``PAIRS_PER_AGG`` pairs (generated code has a size limit);
    each gives one row that is unpivoted, without a driver round trip.
    """
    cols = list(cols)
    x = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    entry = lambda a, b, r: F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("r"))
    pairs = list(combinations(range(len(cols)), 2))
    out = df.sparkSession.createDataFrame([(c, c, 0.0) for c in cols], "col_a string, col_b string, r double")
    for start in range(0, len(pairs), PAIRS_PER_AGG):
        chunk = pairs[start : start + PAIRS_PER_AGG]
        r = {p: _pairwise_r(f"c{p[0]}", f"c{p[1]}") for p in chunk}
        wide = x.agg(*[(F.abs(v) if absolute else v).alias(f"r_{i}_{j}") for (i, j), v in r.items()])
        both = [(i, j) if turn else (j, i) for i, j in chunk for turn in (True, False)]
        entries = [entry(cols[i], cols[j], F.col(f"r_{min(i, j)}_{max(i, j)}")) for i, j in both]
        out = out.unionByName(wide.select(F.inline(F.array(*entries))))
    return out


def validate_prepared(columns: Sequence[str], splits: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """A user split must cover every column exactly once."""
    seen: dict[str, str] = {}
    for name, cols in splits.items():
        for c in cols:
            if c in seen:
                raise ValueError(f"column {c!r} is in splits {seen[c]!r} and {name!r}")
            if c not in columns:
                raise ValueError(f"column {c!r} of split {name!r} is not in the table")
            seen[c] = name
    left = [c for c in columns if c not in seen and c != ROW_ID]
    if left:
        raise ValueError(f"columns {left} are not in any split")
    return {k: list(v) for k, v in splits.items()}


def _seeded_order(items: Sequence[str], seed: int, tag: str) -> list[str]:
    return sorted(items, key=lambda c: hashlib.md5(f"{seed}:{tag}:{c}".encode()).hexdigest())


def split_sizes(n_columns: int, shares: Sequence[float]) -> list[int]:
    """Whole parts of the proportional sizes; what is left over goes to the splits in turn."""
    whole = [int(share / sum(shares) * n_columns) for share in shares]
    turns, ahead = divmod(n_columns - sum(whole), len(whole))
    return [size + turns + (place < ahead) for place, size in enumerate(whole)]


def random_split_columns(columns: Sequence[str], split_ratios: Mapping[str, float], seed: int = 0) -> dict[str, list[str]]:
    """Columns in seeded order, cut into consecutive runs of :func:`split_sizes`."""
    order = _seeded_order([c for c in columns if c != ROW_ID], seed, "columns")
    sizes = split_sizes(len(order), list(split_ratios.values()))
    ends = list(accumulate(sizes))
    if any(size * sum(split_ratios.values()) != share * len(order) for size, share in zip(sizes, split_ratios.values(), strict=True)):
        warnings.warn(f"{len(order)} columns do not divide by the shares; the splits get {sizes}", stacklevel=2)
    return {name: order[end - size : end] for name, size, end in zip(split_ratios, sizes, ends, strict=True)}


def ratio_split(columns: Sequence[str], shares: Sequence[tuple[str, float]], seed: int = 0):
    """C4: ``[(model, shares), ...]`` -> ``{split_i: cols}`` plus the model per split."""
    splits = random_split_columns(columns, {f"split{i}": s for i, (_, s) in enumerate(shares)}, seed)
    return splits, {f"split{i}": m for i, (m, _) in enumerate(shares)}


def correlated_distribute_columns(
    df: DataFrame, columns: Sequence[str], num_splits: int, seed: int = 0, corr: np.ndarray | None = None
) -> dict[str, list[str]]:
    """Greedily send the most correlated remaining pair to two different splits.

    The two splits are a seeded random choice (lower index gets the first
    column).  Columns left once no non-zero correlation remains go round-robin.
    """
    cols = [c for c in columns if c != ROW_ID]
    m = correlation_matrix(df, cols, absolute=True) if corr is None else corr
    rng = np.random.default_rng(seed)
    home: dict[int, int] = {}
    # strongest first, equal ones by place; a pair counts while neither column has a home
    for a, b in sorted(combinations(range(len(cols)), 2), key=lambda p: (-m[p], p)):
        if a not in home and b not in home:
            low, high = np.sort(rng.choice(num_splits, size=2, replace=False))
            home.update({a: int(low), b: int(high)})
    alone = [c for c in range(len(cols)) if c not in home]
    placed = sorted(home.items(), key=lambda x: list(home).index(x[0])) + [(c, k % num_splits) for k, c in enumerate(alone)]
    return {f"split{s}": [cols[c] for c, at in placed if at == s] for s in range(num_splits)}


def largest_pair(m: np.ndarray, remaining: Sequence[int]):
    """Argmax of the remaining upper triangle (first in row-major order wins).

    Returns None only when fewer than two columns remain: a zero correlation
    is still a valid maximum as long as a pair exists.
    """
    if len(remaining) < 2:
        return None
    best, arg = -1.0, None
    for x, i in enumerate(remaining):
        for j in remaining[x + 1 :]:
            if m[i, j] > best:
                best, arg = m[i, j], (i, j)
    return arg


def auto_split(df: DataFrame, columns: Sequence[str], mode: str, n: int, seed: int = 0):
    """Dispatch ``correlated`` / ``random``."""
    if mode == "correlated":
        return correlated_distribute_columns(df, columns, n, seed)
    if mode == "random":
        return random_split_columns(columns, {f"split{i}": 1 for i in range(n)}, seed)
    raise ValueError(f"unknown automated split {mode!r}: use 'correlated' or 'random'")


def split_map_column(splits: Mapping[str, Sequence[str]], col):
    """Literal map column -> split name (no join needed for a parameter)."""
    kv = []
    for s, cols in splits.items():
        for c in cols:
            kv += [F.lit(c), F.lit(s)]
    return F.create_map(*kv)[col]


def ratio_of_correlations(corr_long: DataFrame, splits: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sum of block Frobenius norms across splits / within splits.

    One row ``(interior, exterior, ratio)``; ratio is null when interior is 0.
    """
    blocks = (
        corr_long.withColumn("split_a", split_map_column(splits, F.col("col_a")))
        .withColumn("split_b", split_map_column(splits, F.col("col_b")))
        .where(F.col("split_a").isNotNull() & F.col("split_b").isNotNull())
        .groupBy("split_a", "split_b")
        .agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    )
    same = F.col("split_a") == F.col("split_b")
    return blocks.agg(
        F.sum(F.when(same, F.col("norm")).otherwise(0.0)).alias("interior"),
        F.sum(F.when(~same, F.col("norm")).otherwise(0.0)).alias("exterior"),
    ).select(
        F.round("interior", 6).alias("interior"),
        F.round("exterior", 6).alias("exterior"),
        F.round(F.try_divide(F.col("exterior"), F.col("interior")), 6).alias("ratio"),
    )


def measure_correlation(corr_signed_long: DataFrame, vars1: Sequence[str], vars2: Sequence[str]):
    """Frobenius norm of the signed sub-matrix; diagonal 0 when the lists are equal.

    ``corr_signed_long`` must carry the true diagonal (1, or 0 for a constant
    column) as produced by :func:`signed_with_diagonal`.
    """
    same = list(vars1) == list(vars2)
    sub = corr_signed_long.where(F.col("col_a").isin(list(vars1)) & F.col("col_b").isin(list(vars2)))
    if same:
        sub = sub.where(F.col("col_a") != F.col("col_b"))
    return sub.agg(F.sqrt(F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("norm"))


def signed_with_diagonal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Signed long correlation with the diagonal set to 1 (0 for constant columns)."""
    base = correlation_long(df, cols, absolute=False).where(F.col("col_a") != F.col("col_b"))
    var = df.agg(*[F.stddev_pop(_q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)])
    diag = var.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
                 F.when(F.col(f"s{i}") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r"))
        for i, c in enumerate(cols)
    ])))
    return base.unionByName(diag)


def intra_inter_correlation(df: DataFrame, split0: Sequence[str], split1: Sequence[str]) -> DataFrame:
    """``corr_intra = corr_11 + corr_22`` and ``corr_inter = corr_12 + corr_21`` in one pass."""
    cols = list(split0) + list(split1)
    long = signed_with_diagonal(df, cols)
    s0, s1 = F.col("col_a").isin(list(split0)), F.col("col_b").isin(list(split0))
    t0, t1 = F.col("col_a").isin(list(split1)), F.col("col_b").isin(list(split1))
    off = F.col("col_a") != F.col("col_b")
    sq = F.col("r") * F.col("r")
    agg = long.agg(
        F.sqrt(F.sum(F.when(s0 & s1 & off, sq).otherwise(0.0))).alias("corr_11"),
        F.sqrt(F.sum(F.when(t0 & t1 & off, sq).otherwise(0.0))).alias("corr_22"),
        F.sqrt(F.sum(F.when(s0 & t1, sq).otherwise(0.0))).alias("corr_12"),
        F.sqrt(F.sum(F.when(t0 & s1, sq).otherwise(0.0))).alias("corr_21"),
    )
    return agg.select(
        *[F.round(c, 6).alias(c) for c in ("corr_11", "corr_22", "corr_12", "corr_21")],
        F.round(F.col("corr_11") + F.col("corr_22"), 6).alias("corr_intra"),
        F.round(F.col("corr_12") + F.col("corr_21"), 6).alias("corr_inter"),
    )


def project_splits(df: DataFrame, splits: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One ``(__row_id, cols...)`` projection per split."""
    return {name: df.select(ROW_ID, *[_q(c) for c in cols]) for name, cols in splits.items()}


def label_to_first_split(splits: Mapping[str, Sequence[str]], label: str) -> dict[str, list[str]]:
    """P10: reorder so the split holding ``label`` comes first (names follow position)."""
    items = list(splits.items())
    idx = next(i for i, (_, cols) in enumerate(items) if label in cols)
    items[0], items[idx] = items[idx], items[0]
    return {f"split{i}": list(cols) for i, (_, cols) in enumerate(items)}


def splits_frame(spark: SparkSession, splits: Mapping[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(c, s) for s, cols in splits.items() for c in cols], "column string, split string")
