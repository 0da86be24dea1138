import numpy as np
from pyspark.sql import functions as F

from quiltspark.operators import joins as J
from quiltspark.operators import validators as V
from quiltspark.operators.validators import DensityValidator, IsolationForestValidator, LinearScoreValidator
from quiltspark.plans import harness as H


def _planted(spark, n=400):
    # y depends on x: true rows lie on a line, random re-pairings do not
    a = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") / n).alias("x"))
    b = spark.range(n).select(F.col("id").alias("__row_id"), (F.col("id") / n * 2 + 1 + (F.col("id") * 7 % 13) / 200.0).alias("y"))
    return {"a": a, "b": b}


def test_density_validator_prefers_true_rows(spark):
    parts = _planted(spark)
    v = DensityValidator(k=2, seed=1).fit(parts, number_of_k_fold=0)
    true = J.concatenate(parts)
    fake = J.random_join(parts, 9)
    s_true = v.score(true).agg(F.avg("score")).first()[0]
    s_fake = v.score(fake).agg(F.avg("score")).first()[0]
    assert s_true > s_fake
    assert v.standard_behaviour.max_iter == 50


def test_isolation_forest_ranks_planted_outliers_low(spark):
    parts = _planted(spark)
    v = IsolationForestValidator(n_trees=25, seed=1).fit(parts, number_of_k_fold=2)
    true = J.concatenate(parts)
    far = true.withColumn("y", F.col("y") + 50.0)
    s_true = v.score(true).agg(F.avg("score")).first()[0]
    s_far = v.score(far).agg(F.avg("score")).first()[0]
    assert s_true > s_far
    assert len(v.fold_f1_) == 2 and not v.auto_descending


def test_threshold_sweep_counts(spark):
    df = spark.createDataFrame([(i / 10.0,) for i in range(11)], "score double")
    out = {r["threshold"]: r["accepted"] for r in H.threshold_sweep(df, [0.0, 0.5, 1.0]).collect()}
    assert out == {0.0: 11, 0.5: 6, 1.0: 1}


def test_run_grid_is_resumable(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="quiltspark-grid-") + "/log"
    calls = []

    def run(p):
        calls.append(p)
        return {"m": float(len(calls))}

    axes = {"model": ["a", "b"], "rep": [0, 1]}
    assert H.run_grid(spark, path, axes, run) == 4
    assert H.run_grid(spark, path, axes, run) == 0  # nothing missing
    assert spark.read.parquet(path).count() == 4


def test_repeated_experiment_mean_sem(spark):
    base = spark.range(10).select(F.col("id").alias("__row_id"), F.col("id").cast("double").alias("v"))
    out = H.repeated_experiment(spark, base, lambda df, rep: df.withColumn("v", F.col("v") + rep),
                                lambda syn: {"mean_v": syn.agg(F.avg("v")).first()[0]}, num_reps=3, timed=True)
    got = {r["metric"]: r for r in out.collect()}
    assert abs(got["mean_v"]["mean"] - 5.5) < 1e-9 and "time" in got


def test_linear_validator_checks_columns(spark):
    v = LinearScoreValidator({"x": 1.0})
    try:
        v.score(spark.range(3))
        raise AssertionError("expected a column check")
    except ValueError:
        pass


def test_training_rows_are_counted_by_score(spark):
    """F1: calibration sees a row per score and label, weighted, and finds what all rows give."""
    from pyspark.ml.regression import IsotonicRegression

    rows = [(float(i % 7) / 7, float((i * i) % 3 == 1)) for i in range(300)]
    raw = spark.createDataFrame(rows, "__p double, label double")
    counted = raw.groupBy("__p", "label").agg(F.count(F.lit(1)).cast("double").alias("__w"))
    v = V.ClassifierValidator()
    cal = v._fit_calibrator(raw, counted)
    plain = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__cal").fit(raw)
    assert np.allclose(cal.predictions.toArray(), plain.predictions.toArray())
    wide = raw.withColumn("pred", (F.col("__p") >= 0.5).cast("double"))
    few = counted.withColumn("pred", (F.col("__p") >= 0.5).cast("double"))
    assert V.confusion(few, "label", "pred", 1.0, "__w") == V.confusion(wide, "label", "pred", 1.0)


def test_auto_threshold_scores_rows_once(spark):
    """F1: the rows that an auto threshold is taken from are the ones that are filtered, scored once."""
    seen = spark.sparkContext.accumulator(0)

    class Counting(V.LinearScoreValidator):
        def score(self, df):
            self._check(df)

            def run(batches):
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return df.mapInArrow(run, df.schema).withColumn("score", self.expression())

    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "__pos long, x double")
    kept, threshold = Counting({"x": 0.01}).validate(df, "auto", 0.1)
    assert kept.count() == 11 and threshold == kept.agg(F.min("score")).first()[0]
    assert seen.value == 100


def test_holdout_works_training_rows_out_once(spark):
    """classes, sizes, order statistics and both sides read rows that were worked out once."""
    from quiltspark.operators import sampling as M

    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, i % 2) for i in range(60)], "j long, label int")
    train, test = M.holdout_split(df.mapInArrow(run, df.schema), 5, 1)
    assert (train.count(), test.count()) == (48, 12) and not train.join(test, ["j", "label"]).count()
    assert seen.value == 60
