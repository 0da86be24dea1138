"""U8, U9 work their tables out once (F3, F6); S7's sides are complements."""

import threading

from pyspark.sql import functions as F

from quiltspark.operators import metrics as U
from quiltspark.operators import sampling as M


def _tables(spark, n=120):
    """Real, synthetic and holdout rows, and how many rows of them have been worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def table(shift):
        rows = [(i, "xyz"[i % 3], float((i * 7 + shift) % 50), float((i * i + shift) % 31), float(i % 2)) for i in range(n)]
        df = spark.createDataFrame(rows, "__row_id long, c string, a double, b double, label double")
        return df.mapInArrow(run, df.schema)

    return [table(s) for s in (0, 3, 11)], seen


def test_membership_rounds_work_their_tables_out_once(spark):
    (real, syn, holdout), seen = _tables(spark)
    found = U.membership_inference(real, syn, holdout, ["a", "b"], rounds=3, seed=1)
    assert 0 <= found["mia_recall"] <= 1 and 0 <= found["mia_precision"] <= 1
    assert seen.value == 3 * 120


def test_evaluate_works_its_tables_out_once_and_runs_metrics_at_once(spark, monkeypatch):
    (real, syn, holdout), seen = _tables(spark)
    threads, lock = set(), threading.Lock()
    for name in ("identifiability_risk", "median_dcr", "corr_diff"):
        def counted(*args, _own=getattr(U, name), **kwargs):
            with lock:
                threads.add(threading.get_ident())
            return _own(*args, **kwargs)

        monkeypatch.setattr(U, name, counted)
    out = [r["metric"] for r in U.evaluate(real, syn, holdout, ["c"], ["a", "b"], label="label", seed=1, mia_rounds=1).collect()]
    assert out == ["avg_h_dist", "corr_mat_diff", "pca_eigval_diff", "pca_eigvec_ang", "median_DCR", "eps_identif_risk", "priv_loss_eps",
                   "avg_F1_diff_hout", "auroc", "mia_recall", "mia_precision"]
    assert seen.value == 3 * 120
    assert threads and threading.get_ident() not in threads


def test_split_sides_are_complements_without_a_join(spark):
    """Rows of one id stay on one side, rows without id are not drawn."""
    df = spark.createDataFrame([(i // 2, i) for i in range(40)] + [(None, 100), (None, 101)], "__row_id long, v int")
    for m_share in (0.0, 0.3, 0.5, 1.0):
        train, test = M.train_test_split(df, m_share, seed=5)
        a, b = (sorted(r["v"] for r in x.collect()) for x in (train, test))
        odd = round(m_share * 42) % 2  # then two rows tie at the boundary, one of them is drawn and the other on neither side
        assert not set(a) & set(b) and len(a) + len(b) == 42 - odd
        assert {100, 101} <= set(b)
    train, test = M.train_test_split(spark.range(30).withColumnRenamed("id", "__row_id"), 0.5, seed=2)
    assert "Join" not in test._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r[0] for r in train.union(test).collect()) == list(range(30))
    assert test.agg(F.count("*")).first()[0] == 15
