"""H5-H9: repeated, timed, swept, compared and resumable experiment runs.

Runs are Spark jobs tagged with their parameters; results are long tables
``(run keys..., metric, value)`` appended to a log with Spark's commit
protocol (S4), so concurrent workers never interleave rows in one file.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltspark.operators.aggregates import mean_sem
from quiltspark.operators.joins import missing_runs
from quiltspark.sources.io import append_result_log, exists


def _results_frame(spark: SparkSession, rows: list[tuple], keys: Sequence[str]) -> DataFrame:
    schema = ", ".join([f"{k} string" for k in keys] + ["metric string", "value double"])
    return spark.createDataFrame([tuple(map(str, r[:-2])) + (r[-2], float(r[-1])) for r in rows], schema)


def repeated_experiment(spark: SparkSession, train: DataFrame, generate: Callable[[DataFrame, int], DataFrame],
                        evaluate: Callable[[DataFrame], Mapping[str, float]], num_reps: int = 10,
                        timed: bool = False) -> DataFrame:
    """H5 / H6: ``num_reps`` generations, each evaluated; mean and sem per metric.

    With ``timed`` the wall time of each generation is added as metric ``time`` (A2).
    """
    rows = []
    for rep in range(num_reps):
        t0 = time.time()
        syn = generate(train, rep)
        metrics = dict(evaluate(syn))
        if timed:
            metrics["time"] = time.time() - t0
        rows += [(rep, m, v) for m, v in metrics.items()]
    long = _results_frame(spark, rows, ["rep"])
    return mean_sem(long, ["metric"])


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] | None = None, score: str = "score") -> DataFrame:
    """H7 (one round): accepted candidates for every threshold from one scoring pass.

    One aggregate with one conditional count per threshold (no cross join of
    thresholds and rows), unpivoted to ``(threshold, accepted)``.
    """
    ts = list(thresholds) if thresholds is not None else [round(0.05 * i, 2) for i in range(21)]
    wide = scored.agg(*[F.sum((F.col(score) >= F.lit(t)).cast("long")).alias(f"t{i}") for i, t in enumerate(ts)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"t{i}"), F.lit(0)).cast("long").alias("accepted"))
        for i, t in enumerate(ts)
    ])))


def threshold_sweep_full(parts, make_join: Callable[[float], object], evaluate, thresholds=None):
    """H7 (full): re-join the same parts at every threshold and evaluate each."""
    ts = list(thresholds) if thresholds is not None else [round(0.05 * i, 2) for i in range(21)]
    out = []
    for t in ts:
        joined = make_join(t).join(parts)
        out += [(t, m, v) for m, v in evaluate(joined).items()]
    return out


def validator_comparison(parts, validators: Mapping[str, object], make_join: Callable[[object], object],
                         evaluate, baseline=None, at_once: int = 4):
    """H8: the same parts re-joined by many validators, concatenation as baseline.

    Every join keeps its state in its own object and its rows in its own folders, so
    up to ``at_once`` of them run as concurrent Spark jobs; results come in the given order."""

    def run(name, strategy):
        return [(name, m, v) for m, v in evaluate(strategy.join(parts)).items()]

    runs = [] if baseline is None else [("concat", baseline)]
    runs += [(name, make_join(validator)) for name, validator in validators.items()]
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(runs)))) as pool:
        return [row for rows in pool.map(lambda r: run(*r), runs) for row in rows]


def parameter_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """The run grid of H9 -- a product of *parameter* lists, built on the driver."""
    keys = list(axes)
    return spark.createDataFrame([tuple(map(str, p)) for p in product(*axes.values())],
                                 ", ".join(f"{k} string" for k in keys))


def run_grid(spark: SparkSession, log_path: str, axes: Mapping[str, Sequence],
             run: Callable[[dict], Mapping[str, float]]) -> int:
    """H9: resumable grid -- compute only runs missing from the log (exact anti-join, J8).

    Each finished run is appended to the log at once, so an interrupted grid
    resumes where it stopped.  Returns the number of runs executed.
    """
    keys = list(axes)
    grid = parameter_grid(spark, axes)
    if exists(spark, log_path):
        todo = missing_runs(spark.read.parquet(log_path), grid, keys)
    else:
        todo = grid
    pending = [r.asDict() for r in todo.collect()]  # bounded by the parameter grid
    for params in pending:
        metrics = run(params)
        rows = [tuple(params[k] for k in keys) + (m, v) for m, v in metrics.items()]
        append_result_log(_results_frame(spark, rows, keys), log_path)
    return len(pending)
