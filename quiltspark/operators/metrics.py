"""Utility and privacy metrics of a synthetic table against the real one (U1-U3, U6-U9; U4, U5: privacy.py).

Definitions are ours, from the literature (the reference calls an outside
package): Hellinger distance of marginals, Frobenius norm of the difference of
mixed association matrices, PCA spectra, and classifier-based utility /
membership scores.  Every count or moment is a grouped aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltspark.operators.aggregates import tag_real_synthetic
from quiltspark.operators.encode import OrdinalEncoder
from quiltspark.operators.privacy import identifiability_risk, median_dcr
from quiltspark.operators.splits import PAIRS_PER_AGG, _pairwise_r
from quiltspark.session import materialize


#: Tells MLlib the labels 0 and 1, so that it needs no pass to find how many classes there are.
TWO_CLASSES = {"ml_attr": {"type": "nominal", "vals": ["0", "1"]}}
#: Metrics of U9 that run at once.
METRICS_AT_ONCE = 3


def _q(c: str):
    return F.col(f"`{c}`")


def marginal_buckets(both: DataFrame, discrete: Sequence[str], continuous: Sequence[str], bins: int = 10) -> DataFrame:
    """Long ``(column, data, bucket)``: discrete values as is, continuous in equal bins of the pooled range."""
    pieces = []
    if continuous:
        rng = both.agg(*[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(continuous)],
                       *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(continuous)]).first()
        for i, c in enumerate(continuous):
            lo, hi = rng[f"lo{i}"], rng[f"hi{i}"]
            lo, hi = (lo or 0.0), (hi or 0.0)
            width = (hi - lo) / bins if hi > lo else 1.0
            b = F.least(F.floor((_q(c).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
            b = F.when(_q(c).isNotNull(), b)  # nulls are a bucket of their own
            pieces.append(both.select(F.lit(c).alias("column"), "data", b.cast("long").cast("string").alias("bucket")))
    for c in discrete:
        pieces.append(both.select(F.lit(c).alias("column"), "data", _q(c).cast("string").alias("bucket")))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def hellinger(real: DataFrame, synthetic: DataFrame, discrete: Sequence[str], continuous: Sequence[str],
              bins: int = 10, digits: int = 6) -> DataFrame:
    """Per column ``sqrt(1 - sum sqrt(p*q))`` plus an ``avg_h_dist`` row."""
    cols = list(discrete) + list(continuous)
    both = tag_real_synthetic(real.select(*cols), synthetic.select(*cols))
    long = marginal_buckets(both, discrete, continuous, bins)
    counts = long.groupBy("column", "bucket").agg(
        F.sum((F.col("data") == "Real").cast("double")).alias("nr"),
        F.sum((F.col("data") == "Synthetic").cast("double")).alias("ns"),
    )
    tot = counts.groupBy("column").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts"))
    bc = counts.join(tot, "column").groupBy("column").agg(
        F.sum(F.sqrt((F.col("nr") / F.col("tr")) * (F.col("ns") / F.col("ts")))).alias("bc")
    )
    per = bc.select("column", F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("bc"))).alias("h"))
    avg = per.agg(F.avg("h").alias("h")).select(F.lit("avg_h_dist").alias("column"), "h")
    return per.unionByName(avg).select("column", F.round("h", digits).alias("h_dist"))


def _numeric_moments(df: DataFrame, numeric: Sequence[str]) -> tuple[dict[tuple[str, str], float], dict[str, tuple[float, float]]]:
    """Pearson's r of every pair (rows that have both), and mean and total sum of squares
    of every column, in one aggregate per ``PAIRS_PER_AGG`` pairs."""
    x = df.select(*[_q(c).cast("double").alias(f"c{i}") for i, c in enumerate(numeric)])
    pairs = list(combinations(range(len(numeric)), 2))
    moments = [e.alias(f"{k}{i}") for i in range(len(numeric)) for k, e in (("m", F.avg(f"c{i}")), ("v", F.var_pop(f"c{i}") * F.count(f"c{i}")))]
    r: dict[tuple[str, str], float] = {}
    for at in range(0, max(1, len(pairs)), PAIRS_PER_AGG):
        chunk = pairs[at : at + PAIRS_PER_AGG]
        row = x.agg(*moments, *[_pairwise_r(f"c{i}", f"c{j}").alias(f"r_{i}_{j}") for i, j in chunk]).first()
        for i, j in chunk:
            v = row[f"r_{i}_{j}"]
            r[numeric[i], numeric[j]] = 0.0 if v is None or v != v else float(v)
    return r, {c: (row[f"m{i}"] or 0.0, row[f"v{i}"] or 0.0) for i, c in enumerate(numeric)}


def _cube(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """One row per combination of categories that occurs: its rows, and of each number how
    many values and their sum."""
    sums = [e.alias(f"{k}{j}") for j, c in enumerate(numeric) for k, e in (("c", F.count(_q(c))), ("s", F.sum(_q(c).cast("double"))))]
    keys = [_q(c).cast("string").alias(f"k{i}") for i, c in enumerate(categorical)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def association_matrix(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """Mixed association: Pearson (num-num), correlation ratio (cat-num), Cramer's V (cat-cat).

    Two scans whatever the number of columns: the moments of all numbers, and a sparse
    cube of the combinations of categories that occur.  The cells of every pair are
    sums over the cube, and every pair's figure is one row of one aggregate.  A null
    category is a category; null numbers are left out pair by pair."""
    cols = list(categorical) + list(numeric)
    m = np.eye(len(cols))
    r, moments = _numeric_moments(df, numeric) if numeric else ({}, {})
    place = {c: k for k, c in enumerate(cols)}

    def put(a: str, b: str, v: float) -> None:
        m[place[a], place[b]] = m[place[b], place[a]] = v

    for (a, b), v in r.items():
        put(a, b, v)
    of: list[tuple[str, str]] = []
    records = []
    cell = lambda a, b, n, s: F.struct(F.lit(len(of)).alias("id"), a.alias("a"), b.alias("b"), n.alias("n"), s.alias("s"))
    for i, a in enumerate(categorical):
        for j, b in enumerate(numeric):
            # sums about the mean, so that no digits are lost
            records.append(cell(F.col(f"k{i}"), F.lit(None).cast("string"), F.col(f"c{j}"), F.coalesce(F.col(f"s{j}"), F.lit(0.0)) - F.col(f"c{j}") * F.lit(moments[b][0])))
            of.append((a, b))
        for j in range(i + 1, len(categorical)):
            records.append(cell(F.col(f"k{i}"), F.col(f"k{j}"), F.col("n"), F.lit(0.0)))
            of.append((a, categorical[j]))
    if not records:
        return cols, m
    cells = _cube(df, categorical, numeric).select(F.inline(F.array(*records))).groupBy("id", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_a, by_b = Window.partitionBy("id", "a"), Window.partitionBy("id", "b")
    cells = cells.where("n > 0").select("id", "n", "s", F.sum("n").over(by_a).alias("na"), F.sum("n").over(by_b).alias("nb"),
                                        F.count(F.lit(1)).over(by_a).alias("ka"), F.count(F.lit(1)).over(by_b).alias("kb"))
    found = cells.groupBy("id").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("o"),
        F.sum(1 / F.col("ka")).alias("levels_a"), F.sum(1 / F.col("kb")).alias("levels_b"),
    ).collect()  # a row per pair
    for row in found:
        a, b = of[row["id"]]
        if b in moments:
            total = moments[b][1]
            put(a, b, math.sqrt(max(0.0, row["between"] / total)) if total else 0.0)
        else:
            k = round(min(row["levels_a"], row["levels_b"]))
            put(a, b, math.sqrt(max(0.0, (row["o"] - 1.0) / (k - 1))) if k >= 2 else 0.0)
    for i, a in enumerate(categorical):  # pairs without any row
        for b in [*numeric, *categorical[i + 1 :]]:
            if not any(of[row["id"]] == (a, b) for row in found):
                put(a, b, 0.0)
    return cols, m


def corr_diff(real: DataFrame, synthetic: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> float:
    """Frobenius norm of the difference of the two association matrices.

    Each table is scanned twice; the d x d matrices are the only thing on the driver.
    """
    _, a = association_matrix(real, categorical, numeric)
    _, b = association_matrix(synthetic, categorical, numeric)
    return float(np.linalg.norm(a - b, ord="fro"))


def pca_difference(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str], k: int = 2):
    """Difference of explained-variance ratios and angle between first components.

    Both tables are standardised with the *real* moments, then PCA is fitted
    on each (MLlib; the d x d covariance is the only thing on the driver).
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    va = VectorAssembler(inputCols=list(numeric), outputCol="__x", handleInvalid="skip")
    sc = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(va.transform(real))
    out = {}
    for name, df in (("real", real), ("synthetic", synthetic)):
        z = sc.transform(va.transform(df))
        model = PCA(k=min(k, len(numeric)), inputCol="__z", outputCol="__p").fit(z)
        out[name] = (np.array(model.explainedVariance.toArray()), np.array(model.pc.toArray()))
    ev_r, pc_r = out["real"]
    ev_s, pc_s = out["synthetic"]
    eig_diff = float(np.abs(ev_r - ev_s).sum())
    c = abs(float(np.dot(pc_r[:, 0], pc_s[:, 0])) / (np.linalg.norm(pc_r[:, 0]) * np.linalg.norm(pc_s[:, 0])))
    angle = float(np.arccos(min(1.0, c)))
    return {"pca_eigval_diff": eig_diff, "pca_eigvec_ang": angle}


def classifier_utility(real: DataFrame, synthetic: DataFrame, holdout: DataFrame, features: Sequence[str],
                       label: str, seed: int = 0):
    """Macro F1 and AUROC on the holdout of forests trained on real vs synthetic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from quiltspark.operators.stats import auc_rank_sum

    def fit_eval(train):
        pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"),
                                RandomForestClassifier(labelCol=label, numTrees=50, maxDepth=5, seed=seed)])
        pred = pipe.fit(train.withColumn(label, F.col(label).cast("double"))).transform(
            holdout.withColumn(label, F.col(label).cast("double")))
        # the forest scores the rows once, for both classes' counts and the ranks
        pred = materialize(pred.select(label, "prediction", vector_to_array("probability")[1].alias("__p1")), "utility-scores")
        f1s = []
        for cls in (0.0, 1.0):
            r = pred.agg(F.sum(((F.col("prediction") == cls) & (F.col(label) == cls)).cast("long")).alias("tp"),
                         F.sum(((F.col("prediction") == cls) & (F.col(label) != cls)).cast("long")).alias("fp"),
                         F.sum(((F.col("prediction") != cls) & (F.col(label) == cls)).cast("long")).alias("fn")).first()
            tp, fp, fn = (r["tp"] or 0), (r["fp"] or 0), (r["fn"] or 0)
            f1s.append(0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn))
        auc = auc_rank_sum(pred, "__p1", label, 1.0).first()["auc"]
        return sum(f1s) / 2, auc

    f1_r, auc_r = fit_eval(real)
    f1_s, auc_s = fit_eval(synthetic)
    return {"avg_F1_diff_hout": f1_s - f1_r, "auroc": (auc_s or 0) - (auc_r or 0)}


def membership_inference(real_train: DataFrame, synthetic: DataFrame, holdout: DataFrame, features: Sequence[str],
                         rounds: int = 5, seed: int = 0) -> dict:
    """U8: a forest learns synthetic (+) vs one half of the holdout (-); it is then asked
    to tell all training rows (members) from the other holdout half (non-members).

    Halves are exact seeded splits (S7); recall and precision of "member" are averaged
    over ``rounds``.  The three tables are worked out once and written: every round's halves,
    passes of the fit and predictions read them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from quiltspark.operators.sampling import ROW_ID, train_test_split

    feats = list(features)
    rec, prec = [], []
    real_train, synthetic = materialize(real_train.select(*feats), "mia-members"), materialize(synthetic.select(*feats), "mia-synthetic")
    holdout = materialize(holdout.select(ROW_ID, *[c for c in feats if c != ROW_ID]), "mia-holdout")
    n_hold = holdout.count()
    for r in range(rounds):
        h1, h2 = train_test_split(holdout, 0.5, seed=seed + r, n=n_hold)
        fit_df = synthetic.select(*feats, F.lit(1.0).alias("__y")).unionByName(h1.select(*feats, F.lit(0.0).alias("__y")))
        pipe = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"),
                                RandomForestClassifier(labelCol="__y", numTrees=50, maxDepth=5, seed=seed + r)])
        fit_df = fit_df.withColumn("__y", F.col("__y").alias("__y", metadata=TWO_CLASSES))
        model = pipe.fit(fit_df)
        test = real_train.select(*feats, F.lit(1.0).alias("__y")).unionByName(h2.select(*feats, F.lit(0.0).alias("__y")))
        c = model.transform(test).agg(
            F.sum(((F.col("prediction") == 1.0) & (F.col("__y") == 1.0)).cast("long")).alias("tp"),
            F.sum(((F.col("prediction") == 1.0) & (F.col("__y") == 0.0)).cast("long")).alias("fp"),
            F.sum(((F.col("prediction") == 0.0) & (F.col("__y") == 1.0)).cast("long")).alias("fn"),
        ).first()
        tp, fp, fn = c["tp"] or 0, c["fp"] or 0, c["fn"] or 0
        rec.append(tp / (tp + fn) if tp + fn else 0.0)
        prec.append(tp / (tp + fp) if tp + fp else 0.0)
    return {"mia_recall": float(np.mean(rec)), "mia_precision": float(np.mean(prec))}


def evaluate(real: DataFrame, synthetic: DataFrame, holdout: DataFrame, categorical: Sequence[str],
             numeric: Sequence[str], label: str | None = None, seed: int = 0, mia_rounds: int = 0) -> DataFrame:
    """The metric table ``(metric, value)`` of one synthetic table.

    Every metric reads the three tables, some many times: they are worked out once and written."""
    spark = real.sparkSession
    real, synthetic, holdout = materialize(real, "u9-real"), materialize(synthetic, "u9-synthetic"), materialize(holdout, "u9-holdout")

    def overlap():
        h = hellinger(real, synthetic, categorical, numeric)
        avg = [r["h_dist"] for r in h.collect() if r["column"] == "avg_h_dist"]  # one row per column: tiny
        return [("avg_h_dist", float(avg[0]) if avg else float("nan"))]

    def risk(table):
        return lambda: identifiability_risk(table, synthetic, numeric, categorical)

    jobs = {"risk": risk(real), "other": risk(holdout), "near": lambda: median_dcr(real, synthetic, numeric, categorical)["median_dcr"],
            "overlap": overlap, "corr": lambda: [("corr_mat_diff", corr_diff(real, synthetic, categorical, numeric))]}
    if len(numeric) >= 2:
        jobs["pca"] = lambda: list(pca_difference(real, synthetic, numeric).items())
    if label is not None or mia_rounds:
        # the models take numbers: one dictionary for the values of all three tables
        coded = (real, synthetic, holdout)
        words = [c for c in categorical if dict(real.dtypes)[c] == "string"]
        if words:
            codes = OrdinalEncoder(words).fit(real.select(*words).unionByName(synthetic.select(*words)).unionByName(holdout.select(*words)))
            coded = tuple(materialize(codes.transform(t), "u9-codes") for t in coded)
    if label is not None:
        feats = [c for c in list(categorical) + list(numeric) if c != label]
        jobs["utility"] = lambda: list(classifier_utility(*coded, feats, label, seed).items())
    if mia_rounds:
        jobs["members"] = lambda: list(membership_inference(*coded, list(categorical) + list(numeric), mia_rounds, seed).items())
    # they don't need each other: some run at once, the long ones first
    with ThreadPoolExecutor(max_workers=METRICS_AT_ONCE) as pool:
        found = {name: pool.submit(jobs[name]) for name in ("members", "utility", "risk", "other", "near", "corr", "overlap", "pca") if name in jobs}
    found = {name: f.result() for name, f in found.items()}
    rows = [*found["overlap"], *found["corr"], *found.get("pca", [])]
    near, risk_real, risk_other = found["near"], found["risk"], found["other"]
    rows += [(m, float("nan") if v is None else v) for m, v in (
        ("median_DCR", near), ("eps_identif_risk", risk_real),
        ("priv_loss_eps", None if risk_real is None or risk_other is None else risk_real - risk_other))]
    rows += [*found.get("utility", []), *found.get("members", [])]
    return spark.createDataFrame([(m, float(v)) for m, v in rows], "metric string, value double")
