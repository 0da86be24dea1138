import pytest
from pyspark.sql import functions as F

from quiltspark.operators import joins as J
from quiltspark.operators import sampling as M
from quiltspark.operators.validators import LinearScoreValidator


def _ab_cd(spark):
    ab = spark.createDataFrame([(0, 1, 4), (1, 2, 5), (2, 3, 6)], "__row_id long, A long, B long")
    cd = spark.createDataFrame([(0, 7, 10), (1, 8, 11), (2, 9, 12)], "__row_id long, C long, D long")
    return {"df1": ab, "df2": cd}


def test_concatenate_golden(spark):
    out = J.concatenate(_ab_cd(spark)).orderBy("__row_id").select("A", "B", "C", "D").collect()
    assert [tuple(r) for r in out] == [(1, 4, 7, 10), (2, 5, 8, 11), (3, 6, 9, 12)]


def test_concatenate_unequal_lengths_outer(spark):
    parts = _ab_cd(spark)
    parts["df2"] = parts["df2"].where("__row_id < 2")
    out = J.concatenate(parts).orderBy("__row_id").collect()
    assert len(out) == 3 and out[2]["C"] is None


def test_random_join_is_a_bijection_and_keeps_marginals(spark):
    n = 500
    a = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") * 2).alias("x"))
    b = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") * 3).alias("y"))
    out = J.random_join({"a": a, "b": b}, seed=11).collect()
    assert sorted(r["__pos"] for r in out) == list(range(n))
    assert sorted(r["__id_a"] for r in out) == list(range(n))
    assert sorted(r["__id_b"] for r in out) == list(range(n))
    assert sorted(r["x"] for r in out) == [2 * i for i in range(n)]
    # independent shuffles per part (reference defect D4): rows are re-paired
    assert sum(r["__id_a"] == r["__id_b"] for r in out) < n // 10


def test_random_join_same_seed_same_result_any_shuffle_partitions(spark):
    n = 300
    a = spark.range(n).select(F.col("id").alias("__row_id"), F.col("id").alias("x"))
    b = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") + 1).alias("y"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        r1 = sorted(tuple(r) for r in J.random_join({"a": a, "b": b}, 5).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        r2 = sorted(tuple(r) for r in J.random_join({"a": a, "b": b}, 5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert r1 == r2


def test_a_round_pairs_as_the_random_join_in_one_shuffle(spark):
    for n_a, n_b, width in ((700, 700, 50), (90, 431, 7), (3, 0, 1), (300, 200, 1000)):
        a = spark.createDataFrame([(i if i % 50 != 7 else None, i / 3) for i in range(n_a)], "__row_id int, x double")
        b = spark.createDataFrame([(2 * i, None if i % 9 == 0 else f"v{i}") for i in range(n_b)], "__row_id long, y string")
        parts = {"a": a, "b": b}
        sides = J._sides(parts)
        rows = a.select(*J._side(sides, 0, J.ROW_ID)).unionByName(b.select(*J._side(sides, 1, J.ROW_ID)))
        keyed = J._keyed(rows, sides, 5, ":r3", 2)
        counts = {(r[0], r[1]): r[2] for r in keyed.groupBy("__part", "__b").count().collect()}
        out, expected = J._matched(keyed, sides, counts, 2, width), J.random_join(parts, 5, tag=":r3")
        assert out.dtypes == expected.dtypes
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        assert sorted(out.collect(), key=str) == sorted(expected.collect(), key=str)


def test_validated_join_takes_parts_of_unequal_length(spark):
    a = spark.createDataFrame([(i, float(i)) for i in range(60)], "__row_id long, x double")
    b = spark.createDataFrame([(i, float(i % 7)) for i in range(45)], "__row_id long, y double")
    vj = J.ValidatedJoin(LinearScoreValidator({"x": 0.1, "y": -0.9}), behaviour="strict", max_iter=12, seed=4)
    out = vj.join({"a": a, "b": b}).collect()
    assert all(r["x"] == r["__id_a"] and r["y"] == r["__id_b"] % 7 and 0.1 * r["x"] >= 0.9 * r["y"] for r in out)
    assert sum(h["accepted"] for h in vj.history) == len(out) == len({r["__id_a"] for r in out}) == len({r["__id_b"] for r in out})
    assert [h["pool"] for h in vj.history][:2] == [60, 60 - vj.history[0]["accepted"]]
    assert sorted(r["__row_id"] for r in out) == list(range(len(out))) and {r["__round"] for r in out} <= set(range(12))


def test_validated_join_properties(spark):
    n = 400
    a = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") / n).alias("x"))
    b = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") / n).alias("y"))
    v = LinearScoreValidator({"x": 3.0, "y": -3.0})
    vj = J.ValidatedJoin(v, behaviour="adaptive", max_size=150, seed=2, max_iter=20)
    out = vj.join({"a": a, "b": b}).collect()
    assert len(out) <= 150
    assert len({r["__id_a"] for r in out}) == len(out)  # every source row used at most once
    assert len({r["__id_b"] for r in out}) == len(out)
    assert sorted(r["__row_id"] for r in out) == list(range(len(out)))
    assert all(h["accepted"] >= 0 for h in vj.history)


def test_behaviour_presets():
    v = LinearScoreValidator({"x": 1.0})
    assert J.resolve_behaviour(v, "strict").threshold == 0.5
    assert J.resolve_behaviour(v, "adaptive", patience=9).patience == 9
    with pytest.raises(ValueError):
        J.resolve_behaviour(v, "bogus")


def test_bootstrap_exact_size_and_training_labels(spark):
    n = 200
    a = spark.range(n).select(F.col("id").alias("__row_id"), F.col("id").alias("x"))
    b = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") * 10).alias("y"))
    assert M.bootstrap_exact(a, 2, seed=1).count() == 2 * n
    t = M.setup_training_data({"a": a, "b": b}, 2, seed=3).collect()
    pos = [r for r in t if r["label"] == 1]
    neg = [r for r in t if r["label"] == 0]
    assert len(pos) == len(neg) == 2 * n
    assert all(r["y"] == 10 * r["x"] for r in pos)  # positives are true rows
    assert sum(r["y"] == 10 * r["x"] for r in neg) < n // 5


def test_split_and_folds_exact(spark):
    df = spark.range(103).withColumnRenamed("id", "__row_id")
    train, test = M.train_test_split(df, 0.8, seed=4)
    assert train.count() == 82 and test.count() == 21
    assert train.join(test, "__row_id").count() == 0
    folds = [r["fold"] for r in M.kfold_assign(df, 5, seed=1).collect()]
    assert sorted({f: folds.count(f) for f in set(folds)}.values()) == [20, 20, 21, 21, 21]


def test_top_up_and_head(spark):
    g = spark.range(7).select(F.col("id").alias("__row_id"), (F.col("id") * 2).alias("v"))
    out = M.top_up_samples(g, 20, seed=3).collect()
    assert sorted(r["__row_id"] for r in out) == list(range(20))
    assert {r["v"] for r in out} <= {2 * i for i in range(7)}
    assert M.top_up_samples(g, 4, seed=3).count() == 4
