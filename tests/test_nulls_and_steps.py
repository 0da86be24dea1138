"""Nulls, unequal parts, hot rows, and the stopping rule of the validated join."""

import warnings

import pytest
from pyspark.sql import functions as F

from quiltspark.operators import aggregates as A
from quiltspark.operators import joins as J
from quiltspark.operators import sampling as M
from quiltspark.operators import splits as C
from quiltspark.operators.encode import OrdinalEncoder
from quiltspark.operators.generators.base import generate_synthetic_data
from quiltspark.operators.positions import dense_position, value_position, with_dense_id


def test_null_codes_decode_to_null(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "__row_id long, v string")
    enc = OrdinalEncoder().fit(df)
    back = enc.inverse_transform(enc.transform(df)).collect()
    assert {r["__row_id"]: r["v"] for r in back} == {0: "a", 1: None, 2: "b"}


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(float(i), float(i) if i < 5 else None) for i in range(10)] + [(1000.0, None)], "a double, b double")
    assert C.pair_correlations(df, ["a", "b"])["a", "b"] == pytest.approx(1.0)
    assert {(r["col_a"], r["col_b"]): round(r["r"], 6) for r in C.correlation_long(df, ["a", "b"]).collect()}["b", "a"] == 1.0


def test_histograms_have_a_null_bucket(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (None,)], "x double")
    got = {r["bucket"]: r["share"] for r in A.attribute_histogram(df, df, [], ["x"]).where("data = 'Real'").collect()}
    assert got == {"0": 0.25, "9": 0.25, None: 0.5}
    assert {r["bin"]: r["n"] for r in A.probability_histogram(df, "x").collect()} == {0: 1, 19: 1, None: 2}


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i), None if i % 3 else "g") for i in range(100)], "id long, x double, g string")
    got = value_position(df, ["x", "id"]).collect()
    assert sorted(r["__pos"] for r in got) == list(range(100)) and all(r["__pos"] >= 80 for r in got if r["x"] is None)
    assert value_position(df, ["x", "id"], partition_col="g").count() == 100


def test_unequal_parts(spark):
    parts = {"a": spark.range(10).select(F.col("id").alias("__row_id"), F.lit(1).alias("x")), "b": spark.range(7).select(F.col("id").alias("__row_id"), F.lit(2).alias("y"))}
    got = J.random_join(parts, 3).collect()
    assert len(got) == 10 and sum(r["y"] is None for r in got) == 3
    with pytest.raises(ValueError):
        M.setup_training_data(parts, 2, seed=1)


def test_dense_ids_of_identical_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 900 + [("b", None)] * 100, "s string, n int")
    got = with_dense_id(df.repartition(7)).collect()
    assert sorted(r["__row_id"] for r in got) == list(range(1000)) and sum(r["s"] == "b" for r in got) == 100
    again = {r["__row_id"]: r["s"] for r in with_dense_id(df.repartition(2)).collect()}
    assert {r["__row_id"]: r["s"] for r in got} == again


def test_one_task_positions_equal_the_bucketed_ones(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    a = {r["id"]: r["__pos"] for r in dense_position(df, F.col("k"), "id", n_rows=500).collect()}
    assert a == {r["id"]: r["__pos"] for r in dense_position(df, F.col("k"), "id", digits=2).collect()}


@pytest.mark.parametrize("model", ["bayes_net", "cart"])
def test_generators_with_nulls_return_all_rows(spark, model):
    train = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 7), float(i)) for i in range(120)], "__row_id long, a double, b double")
    ids = sorted(r["__row_id"] for r in generate_synthetic_data(train, model, 150, seed=1).select("__row_id").collect())
    assert ids == list(range(150))


def test_rounds_stop_by_size_and_patience():
    cfg = J.JoinBehaviour(patience=2, min_iter=1, max_iter=50, threshold=0.5, threshold_decay=0.1, auto_threshold_percentage=None)
    p, stop = J.after_round(J.Progress(0.5), 4, cfg, 4)
    assert (p.total, stop) == (4, "size")
    p, stop = J.after_round(J.Progress(0.5), 0, cfg, None)
    assert (p, stop) == (J.Progress(0.5, 1, 0, 0), None)  # within min_iter
    p, stop = J.after_round(p, 0, cfg, None)
    assert (round(p.threshold, 6), p.fruitless, stop) == (0.4, 1, None)
    assert J.after_round(p, 3, cfg, None)[0].fruitless == 0
    p, stop = J.after_round(p, 0, cfg, None)
    assert (round(p.threshold, 6), p.fruitless, stop) == (0.3, 2, None)
    assert J.after_round(p, 3, cfg, None)[1] == "patience"


def test_split_sizes_and_correlated_placement():
    assert C.split_sizes(7, [1, 1, 1]) == [3, 2, 2] and C.split_sizes(5, [3, 1]) == [4, 1] and C.split_sizes(2, [1, 1, 1, 1]) == [1, 1, 0, 0]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert sorted(map(len, C.random_split_columns(list("abcd"), {"x": 1, "y": 1}).values())) == [2, 2]


def test_noise_covers_every_released_table(spark):
    from quiltspark.operators.generators.bayes_net import BayesNetDP

    train = spark.createDataFrame([(i, float(i % 3), float(i % 5)) for i in range(60)], "__row_id long, a double, b double")
    net = BayesNetDP(epsilon=0.5, noise_seed=1).fit(train)
    released = len(net.conditionals) + len(net.marginals)
    assert net.count_noise_scale() == pytest.approx(2 * released / 0.25)
    assert BayesNetDP().noise_seed != BayesNetDP().noise_seed
    assert net.sample(40, seed=2).count() == 40


@pytest.mark.parametrize("name", ["linear_svm", "mlp", "logistic"])
def test_backends_fit_and_score(spark, name):
    from quiltspark.operators.validators import ClassifierValidator, classifier_backend

    a = spark.range(80).select(F.col("id").alias("__row_id"), (F.col("id") % 4).cast("double").alias("x"))
    b = spark.range(80).select(F.col("id").alias("__row_id"), (F.col("id") % 4).cast("double").alias("y"))
    v = ClassifierValidator(classifier_backend(name), seed=1).fit({"a": a, "b": b})
    got = v.score(J.random_join({"a": a, "b": b}, 2)).collect()
    assert len(got) == 80 and all(0 <= r["score"] <= 1 for r in got)
