"""Ranks, comparisons and significance tests over result tables
(W1-W3, F1-F4, V11).

Result tables are long: ``(block..., model, metric, value)``.  Ranks use
windows partitioned by the block/metric (groups as large as the number of
models); anything ordered over a whole column uses the sliced primitives of
:mod:`quiltspark.operators.positions`.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltspark.functions.mathx import chi2_sf, normal_cdf, py_erf
from quiltspark.operators.positions import cumulative_sum, value_position


def rank_models(long_df: DataFrame, maximise: Sequence[str] = (), partition: Sequence[str] = ("metric",),
                model: str = "model", value: str = "mean") -> DataFrame:
    """Per metric rank of models, ties = min; maximised metrics rank descending."""
    direction = F.col("metric").isin(list(maximise)) if maximise else F.lit(False)
    key = F.when(direction, -F.col(value)).otherwise(F.col(value))
    w = Window.partitionBy(*partition).orderBy(key.asc())
    return long_df.withColumn("rank", F.rank().over(w).cast("long"))


def benchmark_rank(long_df: DataFrame, maximise: Sequence[str] = (), model: str = "model",
                   groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Summation rank per model, overall and per metric group (``u_rank`` etc.)."""
    ranked = rank_models(long_df, maximise, model=model)
    aggs = [F.sum("rank").cast("long").alias("rank_sum")]
    for gname, metrics in (groups or {}).items():
        aggs.append(F.sum(F.when(F.col("metric").isin(list(metrics)), F.col("rank")).otherwise(0)).cast("long").alias(gname))
    return ranked.groupBy(model).agg(*aggs)


#: Consecutive positions of a group that one task averages over.
BLOCK_ROWS = 100_000


def moving_average(df: DataFrame, order_col: str, value: str, partition_col: str, id_col: str,
                   window: int = 10, out: str = "moving_avg", digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rolling mean of the last ``window`` rows in ``order_col`` order, ``min_periods=1``.

    Every group's positions are cut into blocks; a block borrows the last ``window`` - 1
    rows of the one before (its halo), so the window within blocks sees all it needs.
    One shuffle after the ranking, ``window`` / ``block_rows`` more rows.  Null values are
    left out of a mean; a null group is a group.
    """
    rows = max(block_rows, window)
    ranked = value_position(df, [order_col, id_col], out="__p", partition_col=partition_col)
    block = F.floor(F.col("__p") / rows)
    lends = F.col("__p") % rows >= rows - (window - 1)
    blocks = F.when(lends, F.array(block, block + 1)).otherwise(F.array(block))
    lent = ranked.withColumn("__b", F.explode(blocks))
    last = Window.partitionBy(partition_col, "__b").orderBy("__p").rowsBetween(1 - window, 0)
    found = lent.withColumn(out, F.round(F.avg(F.col(value).cast("double")).over(last), digits))
    return found.where(F.col("__b") == block).drop("__p", "__b")


def compare_results(res_a: DataFrame, res_b: DataFrame, name_a: str = "A", name_b: str = "B",
                    digits: int = 6) -> DataFrame:
    """F1: metrics in both tables (J7), % difference, z score, two-sided p (normal)."""
    a = res_a.select("metric", F.col("mean").alias("ma"), F.col("sem").alias("sa"))
    b = res_b.select("metric", F.col("mean").alias("mb"), F.col("sem").alias("sb"))
    j = a.join(b, "metric")
    z = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")))
    return j.select(
        "metric",
        F.col("ma").alias(name_a),
        F.col("mb").alias(name_b),
        F.round(F.try_divide(F.col("ma") - F.col("mb"), F.col("mb")) * 100, digits).alias("diff_pct"),
        F.round(z, digits).alias("z_score"),
        F.round(F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z))), digits).alias("p_value"),
    )


def average_ranks(df: DataFrame, block: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Rank within each block, ties get the average rank (1-based)."""
    w = Window.partitionBy(*block).orderBy(F.col(value).asc())
    wt = Window.partitionBy(*block, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(wt) - F.lit(1)) / F.lit(2.0))


def friedman_statistic(df: DataFrame, block: Sequence[str], model: str = "model", value: str = "value",
                       digits: int = 6) -> DataFrame:
    """Friedman chi-square (tie corrected) of models ranked within blocks.

    One row ``(statistic, dof, n_blocks)``; :func:`friedman_test` adds the p value.
    """
    r = average_ranks(df, block, value)
    per_model = r.groupBy(model).agg(F.sum("avg_rank").alias("R"))
    k, ssr = per_model.agg(F.count(F.lit(1)), F.sum(F.col("R") * F.col("R"))).first()
    per_value = r.groupBy(*block, value).agg(F.count(F.lit(1)).alias("t"))
    per_block = per_value.groupBy(*block).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tt"))
    b, tt = per_block.agg(F.count(F.lit(1)), F.coalesce(F.sum("tt"), F.lit(0.0))).first()
    chi2 = float("nan")
    if b and k > 1:
        c = 1.0 - tt / (b * k * (k * k - 1))
        chi2 = (12.0 / (b * k * (k + 1)) * ssr - 3.0 * b * (k + 1)) / c if c > 0 else chi2
    spark = df.sparkSession
    return spark.createDataFrame([(round(chi2, digits), max(k - 1, 0), b)], "statistic double, dof int, n_blocks long")


def friedman_test(df: DataFrame, block: Sequence[str], model: str = "model", value: str = "value"):
    """statistic and p value; both are NaN where all ranks are tied or there is one model."""
    row = friedman_statistic(df, block, model, value, digits=12).first()
    return row["statistic"], float("nan") if math.isnan(row["statistic"]) else chi2_sf(row["statistic"], row["dof"])


def wilcoxon_pairs(wide: DataFrame, models: Sequence[str], digits: int = 6, ties: bool = False) -> DataFrame:
    """F3 statistic: signed-rank sums for every pair of model columns of ``wide``
    (one row per block, one column per model).

    Pairs come from the *parameter* list of models (column expressions), not
    from a self-join; zero and null differences are dropped.  Rows are counted by
    absolute difference before they are ranked, so ties get their average rank
    from a running count, and a hot difference is one row.  ``ties`` adds
    ``tie_sum``, the sum of t**3 - t over tied groups, for the variance.
    """
    pairs = list(combinations(models, 2))
    diffs = wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                 (F.col(a) - F.col(b)).cast("double").alias("d"))
        for a, b in pairs
    ]))).where(F.col("d") != 0)
    per = diffs.groupBy("model_a", "model_b", F.abs("d").alias("absd")).agg(
        F.count(F.when(F.col("d") > 0, 1)).alias("up"), F.count(F.lit(1)).alias("t"))
    per = per.withColumn("pair", F.concat_ws("|", "model_a", "model_b"))
    ranked = cumulative_sum(per, ["absd"], "t", "below", partition_col="pair", inclusive=False)
    r, t = F.col("below") + (F.col("t") + 1) / 2.0, F.col("t").cast("double")
    return ranked.groupBy("model_a", "model_b").agg(
        F.round(F.sum(F.col("up") * r), digits).alias("w_plus"),
        F.round(F.sum((F.col("t") - F.col("up")) * r), digits).alias("w_minus"),
        F.sum("t").cast("long").alias("n"),
        *([F.sum(t * t * t - t).alias("tie_sum")] if ties else []),
    )


EXACT_BLOCKS = 50


def _signed_rank_p(w_plus: float, n: int, tie_sum: float, alternative: str) -> float:
    """p of a signed-rank sum: exact up to ``EXACT_BLOCKS`` untied differences, else normal with tied variance."""
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")
    if not n:
        return 1.0
    if n <= EXACT_BLOCKS and not tie_sum:
        ways = [1] + [0] * (n * (n + 1) // 2)  # how many sign patterns give each sum
        for rank in range(1, n + 1):
            for s in range(len(ways) - 1, rank - 1, -1):
                ways[s] += ways[s - rank]
        w = int(round(w_plus))
        low, high = sum(ways[: w + 1]) / 2.0 ** n, sum(ways[w:]) / 2.0 ** n
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0)
        z = (w_plus - n * (n + 1) / 4.0) / sd
        low, high = (0.5 * (1 + py_erf(s * z / math.sqrt(2.0))) for s in (1, -1))
    return low if alternative == "less" else high if alternative == "greater" else min(1.0, 2.0 * min(low, high))


def holm_wilcoxon(stats_rows, alpha: float = 0.1, alternative: str = "two-sided", correction: str = "holm"):
    """F3 p values of :func:`wilcoxon_pairs` rows, corrected for their number (driver, <= pairs rows).

    ``correction``: ``holm`` (step down), ``bonferroni`` or ``none``; ``less`` asks whether
    ``model_a`` is below ``model_b``.  Rows without ``tie_sum`` count as untied.
    """
    if correction not in ("holm", "bonferroni", "none"):
        raise ValueError(f"unknown correction {correction!r}")
    res = []
    for r in stats_rows:
        r = r.asDict() if hasattr(r, "asDict") else r
        p = _signed_rank_p(r["w_plus"], r["n"], r.get("tie_sum") or 0.0, alternative)
        res.append({"model_a": r["model_a"], "model_b": r["model_b"], "statistic": min(r["w_plus"], r["w_minus"]), "p": p})
    res.sort(key=lambda x: (x["p"], x["model_a"], x["model_b"]))
    m, running = len(res), 0.0
    for i, x in enumerate(res):
        factor = {"holm": m - i, "bonferroni": m, "none": 1}[correction]
        running = max(running, min(1.0, factor * x["p"]))
        x["p_holm" if correction == "holm" else "p_corrected"] = running
        x["reject"] = running < alpha
    return res


def pairwise_test(wide: DataFrame, models: Sequence[str], alpha: float = 0.1, alternative: str = "two-sided",
                  correction: str = "holm", digits: int = 9) -> DataFrame:
    """F3 whole: ``(model_a, model_b, statistic, p_value, p_corrected, reject)``, a row per pair with any block."""
    found = holm_wilcoxon(wilcoxon_pairs(wide, models, digits=6, ties=True).collect(), alpha, alternative, correction)
    rows = [(x["model_a"], x["model_b"], float(x["statistic"]), round(x["p"], digits),
             round(x.get("p_holm", x.get("p_corrected")), digits), bool(x["reject"])) for x in found]
    return wide.sparkSession.createDataFrame(
        rows, "model_a string, model_b string, statistic double, p_value double, p_corrected double, reject boolean")


def auc_rank_sum(df: DataFrame, score: str = "score", label: str = "label", positive=1):
    """Exact ROC AUC = P(s+ > s-) + P(s+ = s-)/2, distributed.

    Rows are first reduced to distinct scores with class counts; a sliced
    running sum of negatives below each score finishes the Mann-Whitney sum.
    """
    per = df.groupBy(F.col(score).alias("__s")).agg(
        F.sum((F.col(label) == positive).cast("double")).alias("__pos"),
        F.sum((F.col(label) != positive).cast("double")).alias("__neg"),
    )
    cum = cumulative_sum(per, ["__s"], "__neg", "__neg_below", inclusive=False)
    return cum.agg(
        F.try_divide(
            F.sum(F.col("__pos") * (F.col("__neg_below") + F.lit(0.5) * F.col("__neg"))),
            F.sum("__pos") * F.sum("__neg"),
        ).alias("auc")
    )


def score_validator(df: DataFrame, prob: str = "score", label: str = "label", threshold: float = 0.5,
                    digits: int = 3) -> DataFrame:
    """Brier, log loss, AUC, precision, recall, F1 in one row, rounded to 3.

    The scored rows are persisted for the two passes (moments + confusion, and
    the AUC rank sum); the one-row result is returned as a DataFrame.
    """
    eps = 1e-15
    data = df.select(F.col(prob).cast("double").alias("__p"), F.col(label).cast("double").alias("__y")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        p = F.least(F.greatest(F.col("__p"), F.lit(eps)), F.lit(1 - eps))
        y = F.col("__y")
        pred = (F.col("__p") >= F.lit(threshold)).cast("double")
        r = data.agg(
            F.avg((F.col("__p") - y) * (F.col("__p") - y)).alias("brier"),
            F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("log_loss"),
            F.sum(pred * y).alias("tp"),
            F.sum(pred * (F.lit(1.0) - y)).alias("fp"),
            F.sum((F.lit(1.0) - pred) * y).alias("fn"),
        ).first()
        auc = auc_rank_sum(data, "__p", "__y", 1.0).first()["auc"]
    finally:
        data.unpersist()
    tp, fp, fn = r["tp"] or 0.0, r["fp"] or 0.0, r["fn"] or 0.0
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    vals = [r["brier"], r["log_loss"], auc if auc is not None else float("nan"), prec, rec, f1]
    names = ["brier", "log_loss", "auc", "precision", "recall", "f1"]
    row = spark_round_row(vals, digits)
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{n} double" for n in names))


def spark_round_row(vals, digits: int):
    """Half-up rounding as Spark's ``round`` does (Python's round is half-even)."""
    from decimal import ROUND_HALF_UP, Decimal

    q = Decimal(1).scaleb(-digits)
    return [float(Decimal(repr(float(v))).quantize(q, rounding=ROUND_HALF_UP)) if v == v else v for v in vals]
