import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltspark.llm import kdtopk, pitmanyor, toxicity
from quiltspark.llm.common import id_text_crc


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def check_model(df, rows):
    got = pitmanyor.scores(df, id_text_crc() % 7 == 2).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = []
    for i, t in rows:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))
        expected.append((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(base, 6)))
    assert collections.Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == collections.Counter(expected)
    assert all(r["score"] <= 1e-9 for r in got)
    return got


def test_model_counts_and_beats_the_base(make_docs):
    rng = np.random.default_rng(1)
    follow = {w: rng.permutation(200)[:20] for w in range(200)}
    rows, w = [], 0
    for i in range(300):
        text = []
        for _ in range(int(rng.integers(5, 80))):
            w = int(rng.choice(follow[w])) if rng.random() < 0.8 else int(min(199, rng.zipf(1.4)))
            text.append(f"t{w:03d}")
        rows.append((i, " ".join(text)))
    got = check_model(make_docs(rows).repartition(3), rows)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert [r["score"] for r in got] == [r["score"] for r in pitmanyor.scores(make_docs(rows).repartition(3), id_text_crc() % 7 == 2).collect()]


def test_model_of_odd_rows_and_many_shards(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(pitmanyor, "SHARD_TOKENS", 9_000)
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", 5_000)
    monkeypatch.setattr(pitmanyor, "SCORE_BYTES", 10_000)
    check_model(make_docs(odd_rows, clash=True), odd_rows)
    assert pitmanyor.scores(make_docs([]), id_text_crc() % 7 == 2).count() == 0


def test_blocks_are_dealt_once(spark, make_docs):
    """The sizes of the shards join the blocks without a shuffle of the blocks."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pitmanyor.scores(make_docs([(1, "a b"), (2, "b c")]), id_text_crc() % 7 == 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("shard_tokens", [4_000_000, 1])
def test_every_word_is_a_context_of_its_own(make_docs, monkeypatch, shard_tokens):
    """One training text of pairs that occur once has only one seating, so its scores are
    known; its words end alike."""
    monkeypatch.setattr(pitmanyor, "SHARD_TOKENS", shard_tokens)
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    train = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(train, "xab yab zab xyab"), (held[0], "yab zab XAB qab xyab"), (held[1], "xab yab zab xyab"), (held[2], None)]
    count = collections.Counter(tokens(rows[0][1]))
    pairs = collections.Counter(zip([None, *tokens(rows[0][1])], tokens(rows[0][1]), strict=False))
    eaten = collections.Counter(c for c, _ in pairs.elements())
    theta, d = pitmanyor.STRENGTH, 0.95  # all pairs and words are seen once: the largest discount

    def p(w, c):
        base = (theta + d * len(count)) / (len(count) + 1)
        parent = (count[w] * (1 - d) + base) / (theta + len(pairs))
        return (pairs[c, w] * (1 - d) + (theta + d * eaten[c]) * parent) / (theta + eaten[c])

    expected = {i: sum(math.log10(p(w, c)) for c, w in zip([None, *tokens(t)], tokens(t), strict=False)) for i, t in rows}
    got = {r["doc_id"]: r["score"] for r in pitmanyor.scores(make_docs(rows), id_text_crc() % 7 == 2).collect()}
    assert got == pytest.approx(expected)


def test_predictive_probabilities_sum_to_one():
    """Over the vocabulary and one unknown word, in every context."""
    words = np.arange(1, 41, dtype=np.uint64) << np.uint64(20)
    rng = np.random.default_rng(3)
    per, context = np.full(40, 3), np.tile(np.array([0, 5, 9], np.uint8), 40)
    count = rng.integers(0, 30, 120)
    count[:6] = 0
    starts = np.arange(0, 120, 3)
    t = pitmanyor.seated(count, rng.uniform(0.1, 5, 120), 0.4, rng)
    customers = np.add.reduceat(t, starts)
    r = pitmanyor.seated(customers, np.full(40, 0.2), 0.6, rng)
    assert ((t >= np.minimum(count, 1)) & (t <= count)).all() and ((r >= np.minimum(customers, 1)) & (r <= customers)).all()
    v = int((np.add.reduceat(count, starts) > 0).sum())
    tables, by = np.bincount(context, t, 64), np.bincount(context, count, 64)
    theta = pitmanyor.STRENGTH
    parent = (customers - 0.6 * r + (theta + 0.6 * r.sum()) / (v + 1)) / (theta + t.sum())
    unknown = (theta + 0.6 * r.sum()) / (v + 1) / (theta + t.sum())
    seen = np.add.reduceat(count, starts) > 0
    for c in (0, 5, 9):
        at = context == c
        spread = (theta + 0.4 * tables[c]) / (theta + by[c])
        p = (count[at] - 0.4 * t[at]) / (theta + by[c]) + spread * parent
        assert p[seen].sum() + spread * unknown == pytest.approx(1)
    assert len(words) == len(per)


def test_gibbs_seating_has_the_right_distribution():
    d, worth, m = 0.4, 1.7, 60_000
    t = pitmanyor.seated(np.full(m, 3), np.full(m, worth), d, np.random.default_rng(0))
    weight = np.array([worth * (1 - d) * (2 - d), 3 * worth**2 * (1 - d), worth**3])
    assert np.bincount(t, minlength=4)[1:] / m == pytest.approx(weight / weight.sum(), abs=0.01)


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k):
    """Every row is a candidate of its own; the queries of one id are ranked together."""
    of = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            of.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    found = collections.defaultdict(list)
    for q, v in of:
        if q % 50 == 0:
            found[q] += [(-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in of if c != q and len(w) == len(v)]
    return sorted((q, r + 1, c, -s) for q, best in found.items() for r, (s, c) in enumerate(sorted(best)[:k]))


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_top_k_matches_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(kdtopk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(kdtopk, "BLOCK_ROWS", 5)
    monkeypatch.setattr(kdtopk, "LEAF_ROWS", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(None, [1.0] * 6), (50, None), (500, [float("nan")] + [1.0] * 5), (501, [float("inf")] * 6), (502, [None] + [1.0] * 5), (503, []), (550, [])]
    rows += [(600, [9.0, 9.0]), (601, [1.0, 2.0]), (7, [0.0] * 6), (100, rows[100][1])]
    rows += [(8, [3.0] * 6), (8, [2.9] * 6), (150, [1.0] * 6), *[(9, [2.5] * 6)] * 9, *[(200, [-1.0] * 6)] * 3]  # repeated ids, repeated rows
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("score", F.lit("x")).withColumn("shard", F.lit(1))
    got = sorted(tuple(r) for r in kdtopk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == brute_top(rows, 5)
    assert kdtopk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_top_k_with_large_components_is_exact():
    x = np.array([[2**30, 1], [2**30, 2], [-(2**30), 5]], np.int64)
    assert kdtopk.exact_kind(x, x) is np.int64
    tree = kdtopk.Tree(x)
    q = x[0]
    bounds = np.maximum(q, 0) @ tree.hi.T + np.minimum(q, 0) @ tree.lo.T
    found = kdtopk.search(tree, np.arange(3)[tree.order], q, 0, bounds, None, 2)
    assert found == sorted(((int(x[i] @ q), i) for i in (1, 2)), key=lambda f: (-f[0], f[1]))


def toxic_rows(n=240):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "ne") for b in ("man", "ter", "ling", "do", "pra")]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(plain, int(rng.integers(20, 120))).tolist()
        bad = int(i % 4 == 0)
        for k in rng.integers(0, len(w), 2 * bad):
            w[k] = str(rng.choice(["vilegrub", "vilegrubs", "scumhead", "scumheads"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, bad))
    return rows, labels


def test_toxicity_on_held_out_rows_and_misspellings(spark, make_docs):
    rows, labels = toxic_rows()
    extra = [(1000, "lomater vilegrubb taling " + "sudo " * 30), (1001, None), (1002, ""), (1003, " ... "), (None, "scumhead " * 3), (1004, "x" * 100_000), (1000, "lomater")]
    docs = make_docs(rows + extra, clash=True)
    model = toxicity.fit(docs, spark.createDataFrame(labels + [(3, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, model).collect()
    held = [(r["predicted"], labels[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert by[1000, extra[0][1]]["predicted"] == 1 and by[None, "scumhead scumhead scumhead "]["predicted"] == 1
    assert by[1001, None]["score"] == by[1002, ""]["score"] < 0.5 and by[1003, " ... "]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["rep"] == "rep" for r in got)
    assert len(got) == len(rows) + len(extra)


def test_toxicity_without_both_classes(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, "c")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0, 0), (2, 0, 0)], none.schema)):
        assert [r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumn("score", F.lit(1)), toxicity.train([], [], 0.0))
