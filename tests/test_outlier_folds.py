"""V8: all folds of the isolation forest in one grouped job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltspark.operators import joins as J
from quiltspark.operators.sampling import holdout_split, setup_training_data, subsample_negatives
from quiltspark.operators.validators import IsolationForestValidator, _avg_path, f1_from_counts


def _parts(spark, n=400):
    x = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") % 20).cast("double").alias("x"))
    y = spark.range(n).select(F.col("id").alias("__row_id"), (100.0 * (F.col("id") % 20)).alias("y"))
    return {"a": x, "b": y}


def _data(parts, seed):
    return subsample_negatives(setup_training_data(parts, 2, seed=seed, negative_class=-1), seed, negative_class=-1)


def test_hold_outs_are_those_of_the_split(spark):
    parts = _parts(spark)
    v = IsolationForestValidator(seed=3)
    v.features = ["x", "y"]
    data = _data(parts, 3)
    folds = v._folds(data, 3, 3).collect()
    every = {(r["label"], r["j"]) for r in data.collect()}
    assert {(r["label"], r["j"]) for r in folds if r["__forest"] == 0 and not r["__test"]} == every
    for i in (1, 2, 3):
        test = {(r["label"], r["j"]) for r in holdout_split(data, 3, 3 + i - 1)[1].collect()}
        assert {(r["label"], r["j"]) for r in folds if r["__forest"] == i and r["__test"]} == test
        assert {(r["label"], r["j"]) for r in folds if r["__forest"] == i and not r["__test"]} == every - test


def _walk(row, forest, psi):
    total = 0.0
    for feature, split, left, right, size in forest:
        node = depth = 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] < split[node] else right[node]
            depth += 1
        total += depth + float(_avg_path(np.array([size[node]]))[0])
    return 2.0 ** (-(total / len(forest)) / float(_avg_path(np.array([psi]))[0]))


def test_fold_f1_equals_row_by_row_scoring(spark, monkeypatch):
    parts, kept = _parts(spark), {}
    grow = IsolationForestValidator._grow

    def noted(self, data, sizes):
        kept.update(grow(self, data, sizes))
        return dict(kept)

    monkeypatch.setattr(IsolationForestValidator, "_grow", noted)
    v = IsolationForestValidator(n_trees=8, sample_size=64, seed=3).fit(parts, number_of_k_fold=2)
    assert sorted(kept) == [0, 1, 2] and all(len(f) == 8 and psi == 64 for f, psi in kept.values())
    folds = v._folds(_data(parts, 3), 2, 3).collect()
    for g in (1, 2):
        train = sorted(_walk((r["x"], r["y"]), *kept[g]) for r in folds if r["__forest"] == g and not r["__test"])
        cut = train[min(int(0.75 * len(train)), len(train) - 1)]
        said = [(r["label"], 1 if _walk((r["x"], r["y"]), *kept[g]) <= cut else -1) for r in folds if r["__forest"] == g and r["__test"]]
        n = lambda a, b: sum(1 for x in said if x == (a, b))
        want = (f1_from_counts(n(1, 1), n(-1, 1), n(1, -1)) + f1_from_counts(n(-1, -1), n(1, -1), n(-1, 1))) / 2
        assert v.fold_f1_[g - 1] == pytest.approx(want)


def test_folds_leave_the_final_forest_as_it_is(spark):
    parts = _parts(spark)
    true = J.concatenate(parts)
    a = IsolationForestValidator(n_trees=10, seed=1).fit(parts, number_of_k_fold=0)
    b = IsolationForestValidator(n_trees=10, seed=1).fit(parts, number_of_k_fold=3)
    assert a.fold_f1_ == [] and len(b.fold_f1_) == 3 and a.offset_ == pytest.approx(b.offset_)
    assert a.score(true).select("score").exceptAll(b.score(true).select("score")).count() == 0
    with pytest.raises(ValueError):
        IsolationForestValidator().fit(parts, number_of_k_fold=1)


def test_subsamples_are_the_smallest_hashes_without_interpreted_functions(spark):
    """every tree has the rows of smallest hash, drawn in compiled code (no lambda in the plan)."""
    v = IsolationForestValidator(n_trees=3, sample_size=8, seed=5)
    v.features = ["x"]
    df = spark.range(400).select(F.col("id").alias("j"), (F.col("id") % 2).cast("int").alias("__forest"), (F.col("id") % 13).cast("double").alias("x"))
    picked = v._subsamples(df, {0: 200, 1: 200})
    assert set(picked.columns) == {"j", "__forest", "x", "tree", "u"}
    got = {}
    for r in picked.collect():
        got.setdefault(r["tree"], set()).add(r["j"])
    plan = picked._jdf.queryExecution().analyzed().toString()
    picked.unpersist()
    for g in (0, 1):
        for t in range(3):
            u = F.xxhash64(F.lit(5), F.lit(g * 3 + t), F.col("j"))
            want = {r["j"] for r in df.where(F.col("__forest") == g).orderBy(u, "j").limit(8).collect()}
            assert got[g * 3 + t] == want
    assert "lambda" not in plan
