"""Exact neighbours, the privacy metrics and the k-NN backend against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltspark.operators import nearest as N
from quiltspark.operators import privacy as P
from quiltspark.operators.joins import random_join
from quiltspark.operators.positions import kth_value
from quiltspark.operators.validators import ClassifierValidator, classifier_backend

KIND = "a double, b long, c string, d int"


def rows_of(seed, n, hot=0.3):
    """Ties, nulls, repeated rows, and one row that is ``hot`` of all."""
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.08 else v
    some = [(maybe(rng.randrange(50) / 2), maybe(rng.randrange(9)), maybe(rng.choice("xyz")), maybe(rng.randrange(3))) for _ in range(n)]
    return some + [some[0]] * int(hot * n)


def brute(x, y, scales, weights):
    total = 0.0
    for j, (p, q) in enumerate(zip(x, y, strict=True)):
        if p is None or q is None or j >= len(scales):
            total += 0.0 if p == q else weights[j]
        else:
            total += abs(p - q) / scales[j] * weights[j]
    return total


def scales_of(rows, k):
    out = []
    for j in range(k):
        v = [r[j] for r in rows if r[j] is not None]
        out.append(max(v) - min(v) or 1.0)
    return out


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 12)
    monkeypatch.setattr(N, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(N, "LEAF_POINTS", 3)


def test_dcr_and_risk_match_all_pairs(spark, small_cells):
    real, syn = rows_of(1, 90), rows_of(2, 70)
    scale = scales_of(real, 2)
    r, s = spark.createDataFrame(real, KIND), spark.createDataFrame(syn, KIND)
    cols = (["a", "b"], ["c", "d"])
    to_real = [min(brute(x, y, scale, [1] * 4) for y in real) for x in syn]
    own = [min(brute(x, y, scale, [1] * 4) for j, y in enumerate(real) if j != i) for i, x in enumerate(real)]
    got = P.median_dcr(r, s, *cols)
    assert got["median_synthetic"] == pytest.approx(np.median(to_real)) and got["median_real"] == pytest.approx(np.median(own))

    weights = []
    for j in range(4):
        n = np.unique([str(x[j]) for x in real], return_counts=True)[1] / len(real)
        weights.append(1 / -(n * np.log(n)).sum())
    assert P.inverse_entropies(r, ["a", "b", "c", "d"]) == pytest.approx(dict(zip("abcd", weights, strict=True)))
    risk = []
    for i, x in enumerate(real):
        other = min(brute(x, y, scale, weights) for j, y in enumerate(real) if j != i)
        risk.append(round(min(brute(x, y, scale, weights) for y in syn), 9) < round(other, 9))
    assert P.identifiability_risk(r, s, *cols) == pytest.approx(np.mean(risk))
    loss = P.privacy_loss(r, s, s, *cols)
    assert loss["eps_identif_risk"] == pytest.approx(np.mean(risk)) and loss["priv_loss_eps"] == pytest.approx(np.mean(risk) - P.identifiability_risk(s, s, *cols))


def test_a_constant_column_has_no_weight_and_empty_tables_no_figure(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x")], "a double, c string")
    assert P.inverse_entropies(df, ["a", "c"]) == {"a": pytest.approx(1 / math.log(2)), "c": 0.0}
    none = df.limit(0)
    assert P.median_dcr(df, none, ["a"], ["c"])["median_synthetic"] is None
    assert P.median_dcr(none, df, ["a"], ["c"])["median_synthetic"] is None
    assert P.identifiability_risk(none, df, ["a"], ["c"]) is None
    assert P.identifiability_risk(df, none, ["a"], ["c"]) == 0.0
    assert P.median_dcr(df.limit(1), df, ["a"], ["c"])["median_real"] is None


def test_a_hot_row_is_one_point(spark, small_cells):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1.0).otherwise(F.col("id").cast("double")).alias("a"))
    space = N.Space.of(df, ["a"], [])
    assert space.points(df).count() == 1001
    own = N.own_nearest_distances(df, space)
    assert own.agg(F.sum("n"), F.max(F.when(F.col("n") > 1, F.col("d")))).first()[:] == (5000, 0.0)


def knn_score(x, train, k):
    d = sorted((sum((1.0 if (p is None) != (q is None) else 0.0 if p is None else (p - q) ** 2) for p, q in zip(x, t, strict=True)) ** 0.5, y) for t, y in train)
    if d[0][0] == 0:
        return float(np.mean([y for v, y in d if v == 0]))
    last = d[k - 1][0]
    sure = [(1 / v, y) for v, y in d if v < last]
    tied = [y for v, y in d if v == last]
    share = (k - len(sure)) / len(tied)
    up = sum(w * y for w, y in sure) + share * sum(tied) / last
    return up / (sum(w for w, _ in sure) + share * len(tied) / last)


def test_knn_backend_votes_as_all_pairs(spark, small_cells):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(12)), float(rng.randrange(12)), None if rng.random() < 0.1 else float(rng.randrange(5))) for i in range(120)]
    df = spark.createDataFrame(rows, "__row_id long, a double, b double, c double")
    parts = {"s": df.select("__row_id", "a"), "t": df.select("__row_id", "b", "c")}
    v = ClassifierValidator(classifier_backend("knn"), calibration=None, seed=1).fit(parts)
    from quiltspark.operators.sampling import setup_training_data

    train = [((r["a"], r["b"], r["c"]), r["label"]) for r in setup_training_data(parts, 2, seed=1).collect()]
    asked = random_join(parts, 9)
    got = v.score(asked).select("a", "b", "c", "score").collect()
    assert len(got) == 120
    for r in got:
        assert r["score"] == pytest.approx(knn_score((r["a"], r["b"], r["c"]), train, 15), abs=1e-9), r


def test_queries_on_training_rows_are_not_searched(spark, monkeypatch):
    from quiltspark.operators import knn

    asked, search = [], knn.neighbours
    monkeypatch.setattr(knn, "neighbours", lambda q, *a, **k: asked.append(q.count()) or search(q, *a, **k))
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["a"], outputCol="features").setHandleInvalid("keep").transform(
        spark.createDataFrame([(float(i % 10) if i % 11 else None, float(i % 3 == 0)) for i in range(60)], "a double, label double"))
    model = classifier_backend("knn").setFeaturesCol("features").setLabelCol("label").fit(rows)
    got = {r["a"]: r["probability"][1] for r in model.transform(rows).select("a", "probability").collect()}
    votes = {}
    for r in rows.collect():
        votes.setdefault(r["a"], []).append(r["label"])
    assert got == pytest.approx({a: np.mean(y) for a, y in votes.items()}) and asked == []
    other = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(0.5,), (1.0,)], "a double"))
    assert model.transform(other).where("prediction is not null").count() == 2 and asked == [1]


def test_search_holds_the_nearest_with_all_ties(monkeypatch):
    monkeypatch.setattr(N, "LEAF_POINTS", 20)
    monkeypatch.setattr(N, "LOOKED_AT", 100)
    rng = np.random.default_rng(4)
    num = np.unique(rng.integers(0, 25, (400, 2)), axis=0).astype(float)
    n, m = rng.integers(1, 4, len(num)), rng.integers(0, 3, len(num)).astype(float)
    asked = np.concatenate((rng.integers(0, 25, (60, 2)), rng.integers(-9, 40, (20, 2)) + 0.25))
    weights = ([1.0, 1.0], [], 2)
    for k in (1, 2, 7, 1000):
        for apart in (False, True):
            none = np.zeros((len(asked), 0), np.int64)
            (d, count, load), radius = N.search(asked, none, np.full(len(asked), np.inf), (num, np.zeros((len(num), 0), np.int64), n, m), weights, k, apart)
            for i, q in enumerate(asked):
                far = ((num - q) ** 2).sum(1)
                far = np.where(apart & (far == 0), np.inf, far)
                expected, rows = [], 0
                for x in np.unique(far[far < np.inf]):
                    if rows >= k:
                        break
                    rows += n[far == x].sum()
                    expected.append((x, n[far == x].sum(), m[far == x].sum()))
                there = d[i] < np.inf
                if k == 1:
                    assert d[i].tolist() == [expected[0][0]]
                else:
                    assert list(zip(d[i][there], count[i][there], load[i][there], strict=True)) == expected
                    assert radius[i] == (expected[-1][0] if rows >= k else np.inf)


def test_order_statistics_with_nan_infinities_and_weights(spark):
    values = [float("nan")] * 4 + [float("inf"), float("-inf"), 1e308, -1e308, 0.0, -0.0, 5e-324, 2.5, None] + [7.0] * 300
    df = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "x double, w long")
    key = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    plain = sorted([v for v in values if v is not None], key=key)
    heavy = sorted([v for i, v in enumerate(values) if v is not None for _ in range(1 + i % 3)], key=key)
    same = lambda a, b: a == b or (math.isnan(a) and math.isnan(b))
    for k in (0, 1, 3, 5, 100, len(plain) - 6, len(plain) - 5, len(plain) - 1):
        assert same(kth_value(df, "x", k, max_collect=3), plain[k]), k
        assert same(kth_value(df, "x", k, descending=True, max_collect=3), plain[-1 - k]), k
    for k in (0, 4, 300, len(heavy) - 12, len(heavy) - 1):
        assert same(kth_value(df, "x", k, weight="w", max_collect=3), heavy[k]), k
    assert kth_value(df, "x", len(plain)) is None


def test_knn_training_votes_are_what_the_model_gives_its_training_rows(spark):
    """the fit's own rows are counted from the points, not searched or looked up."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from quiltspark.operators.knn import KNeighborsClassifier
    from quiltspark.operators.validators import assemble

    rows = [(float(i % 7), None if i % 11 == 0 else float(i % 3), float((i * i) % 5 < 2)) for i in range(200)]
    df = assemble(["a", "b"]).transform(spark.createDataFrame(rows, "a double, b double, label double"))
    model = KNeighborsClassifier(k=3).setFeaturesCol("features").setLabelCol("label").fit(df)
    got = {(r["__p"], r["label"]): r["__w"] for r in model.training_votes().collect()}
    scored = model.transform(df).select(vector_to_array("probability")[1].alias("p"), "label")
    assert got == {(r["p"], r["label"]): float(r["n"]) for r in scored.groupBy("p", "label").agg(F.count("*").alias("n")).collect()}
