import math

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

from quiltspark.operators import validators as V


def test_mixtures_of_all_folds_are_those_of_mllib(spark):
    """One step fits every fold's mixture; each is what MLlib fits to the fold's rows alone."""
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal(4, [2, 0.5], (150, 2))])
    df = spark.createDataFrame([(i, i % 3, float(a), float(b)) for i, (a, b) in enumerate(data)], "j long, fold int, a double, b double").persist()
    v = V.DensityValidator(seed=7)
    v.features = ["a", "b"]
    rows = {m: df.where(F.col("fold") != m) for m in range(4)}
    got = v._fit_mixtures(df, {m: v._start(r) for m, r in rows.items()})
    for m, r in rows.items():
        model = GaussianMixture(k=2, seed=7, maxIter=100, featuresCol="features").fit(V.assemble(["a", "b"]).transform(r))
        for (logw, mu, prec, logdet), w, g in zip(got[m], model.weights, model.gaussians, strict=True):
            assert math.exp(logw) == pytest.approx(w, rel=1e-6)
            assert mu == pytest.approx(g.mean.toArray(), rel=1e-6)
            assert prec == pytest.approx(np.linalg.inv(g.cov.toArray() + 1e-9 * np.eye(2)), rel=1e-5)


def test_walk_ends_in_the_leaf_that_the_splits_name():
    rng = np.random.default_rng(4)
    import pandas as pd

    sub = pd.DataFrame({"tree": 0, "a": rng.normal(size=60), "b": rng.normal(size=60).round(1)})
    tree = V._build_tree(sub, ["a", "b"], 6, 3)
    start, split, child, steps, length = V._walked(*(tree[c].to_numpy() for c in ("feature", "split", "left", "right", "size")))
    for x in [*rng.normal(size=(200, 2)), np.array([np.nan, 0.0]), np.array([0.0, np.nan])]:
        node = 0
        for _ in range(steps):
            node = child[2 * node + (not x[start[node]] < split[node])]
        at, depth = 0, 0
        while tree.feature[at] >= 0:
            at, depth = int(tree.left[at] if x[tree.feature[at]] < tree.split[at] else tree.right[at]), depth + 1
        assert node == at
        assert length[node] == depth + V._avg_path([tree["size"][at]])[0]


def _mixed_rows(spark):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(50, 3, (90, 2)), rng.normal(-20, [9, 1], (60, 2))])
    return spark.createDataFrame([(i, i % 3, float(a), float(b)) for i, (a, b) in enumerate(data)], "j long, fold int, a double, b double").persist()


def test_mixture_starts_from_the_rows_that_mllib_draws(spark):
    v = V.DensityValidator(k=3, seed=11)
    v.features = ["a", "b"]
    for rows in (df := _mixed_rows(spark), df.where("fold <> 1")):
        model = GaussianMixture(k=3, seed=11, maxIter=0, featuresCol="features").fit(V.assemble(["a", "b"]).transform(rows))
        weights, means, covs = v._start(rows)
        assert weights == pytest.approx(np.array(model.weights))
        for mu, cov, g in zip(means, covs, model.gaussians, strict=True):
            assert mu == pytest.approx(g.mean.toArray(), rel=1e-12)
            assert cov == pytest.approx(g.cov.toArray(), rel=1e-9, abs=1e-12)


def test_density_by_fold_is_that_of_the_folds_mixture(spark):
    """One expression for all folds, whose size does not grow with them."""
    df = _mixed_rows(spark)
    v = V.DensityValidator(seed=7)
    v.features = ["a", "b"]
    fitted = v._fit_mixtures(df, {m: v._start(df.where(F.col("fold") != m)) for m in range(3)})
    found = df.select("fold", v._fold_logdensity([fitted[m] for m in range(3)]).alias("got"), *[v._logdensity(fitted[m]).alias(f"d{m}") for m in range(3)])
    assert all(r["got"] == pytest.approx(r[f"d{r['fold']}"], rel=1e-12) for r in found.collect())


def test_mixture_refuses_rows_without_a_value(spark):
    df = _mixed_rows(spark).withColumn("b", F.when(F.col("j") != 4, F.col("b")))
    v = V.DensityValidator(seed=7)
    v.features = ["a", "b"]
    start = (np.array([0.5, 0.5]), np.array([[50.0, 50.0], [-20.0, -20.0]]), np.array([np.eye(2), np.eye(2)]))
    with pytest.raises(ValueError, match="null, NaN"):
        v._fit_mixtures(df, {3: start})
