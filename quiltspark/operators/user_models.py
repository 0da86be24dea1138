"""One-class and outlier validators around a model the user brings.

A model is any Python object with numpy methods; which ones is checked when the
validator is made.  It is fitted in tasks, one per fold and one for the final
model, all in one job, on at most about ``fit_rows`` rows each, drawn by a seeded
hash of the row's id (all rows, if there are fewer).  The fitted models come back
pickled, no larger than ``max_model_bytes``.  Scoring sends the final model to the
workers once and applies it to Arrow batches of all rows.

Nulls reach the model as NaN.  Feature columns must be numeric (encode others
first).  An empty table scores to an empty table; fitting on one raises.
"""

from __future__ import annotations

import pickle
import sys
import sysconfig
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltspark.operators.joins import feature_columns
from quiltspark.operators.sampling import holdout_split, kfold_assign, setup_training_data, subsample_negatives
from quiltspark.operators.validators import ONE_CLASS_STANDARD, OUTLIER_STANDARD, Validator, f1_from_counts
from quiltspark.session import materialize


class UnsuitableModel(ValueError):
    """The model lacks a method that the validator needs."""


class ModelTooLarge(RuntimeError):
    """A fitted model takes more bytes than may be sent to every worker."""


_MODELS: dict[str, object] = {}


def _pickled(model) -> bytes:
    """The model with its class, if that is from a script of the user's and not from an
    installed package, which workers can import."""
    module = sys.modules.get(type(model).__module__)
    place = getattr(module, "__file__", None)
    by_value = place is not None and not place.startswith((sysconfig.get_paths()["purelib"], sysconfig.get_paths()["stdlib"]))
    if by_value:
        cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(model)
    finally:
        if by_value:
            cloudpickle.unregister_pickle_by_value(module)


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names])


class UserModelValidator(Validator):
    needs: tuple[str, ...] = ("fit", "predict")

    def __init__(self, model, seed: int = 0, fit_rows: int = 100_000, max_model_bytes: int = 64 << 20):
        if lacking := [m for m in self.needs if not callable(getattr(model, m, None))]:
            raise UnsuitableModel(f"{type(model).__name__} has no method {' or '.join(lacking)}; {type(self).__name__} needs {', '.join(self.needs)}")
        self.model, self.seed, self.fit_rows, self.max_model_bytes = model, seed, fit_rows, max_model_bytes

    def _fit_groups(self, rows: DataFrame) -> dict[int, bytes]:
        """One fitted model per ``__g``, from rows with ``j`` and the features."""
        sizes = {r["__g"]: r["n"] for r in rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per fold
        if not sizes:
            raise ValueError("no rows to fit the model on")
        u = F.pmod(F.xxhash64(F.lit(self.seed), "__g", "j"), F.lit(1 << 32)) / F.lit(float(1 << 32))
        share = F.element_at(F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, self.fit_rows / n))]), F.col("__g"))
        names, blank, most = list(self.features), _pickled(self.model), self.max_model_bytes

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            model = pickle.loads(blank)
            x = pdf.sort_values("j")[names].to_numpy(dtype=float)
            model = model.fit(x) or model
            raw = cloudpickle.dumps(model)
            if len(raw) > most:
                raise ModelTooLarge(f"the fitted model takes {len(raw)} bytes, more than {most}")
            return pd.DataFrame({"g": [int(pdf["__g"].iloc[0])], "model": [raw]})

        sampled = rows.where(u < share).select("__g", "j", *[F.col(f"`{c}`").cast("double") for c in names])
        return {r["g"]: bytes(r["model"]) for r in sampled.groupBy("__g").applyInPandas(fit, "g int, model binary").collect()}

    def _apply(self, df: DataFrame, models: Mapping[int, bytes], method: str, out: str, group: str | None = None) -> DataFrame:
        """``out``: what the method gives for each row, by the model of its ``group`` (or the only one)."""
        names, key = list(self.features), uuid.uuid4().hex
        sent = df.sparkSession.sparkContext.broadcast(dict(models))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = np.full(batch.num_rows, np.nan)
                if batch.num_rows:
                    x = _matrix(batch, names)
                    of = batch.column(group).to_numpy() if group else np.full(batch.num_rows, next(iter(sent.value)))
                    for g in np.unique(of).tolist():
                        if f"{key}:{g}" not in _MODELS:
                            _MODELS.clear()  # models of earlier validators
                            _MODELS.update((f"{key}:{k}", pickle.loads(raw)) for k, raw in sent.value.items())
                        mine = of == g
                        value[mine] = np.asarray(getattr(_MODELS[f"{key}:{g}"], method)(x[mine]), float).reshape(-1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))

    def _fold_counts(self, tested: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
        """fold -> {(label, predicted label): rows}, one aggregate for all folds."""
        out: dict[int, dict[tuple[int, int], int]] = {}
        for r in tested.groupBy("__g", "label", "__pred").count().collect():  # four rows a fold
            out.setdefault(r["__g"], {})[r["label"], r["__pred"]] = r["count"]
        return out

    @staticmethod
    def _f1(counts: Mapping[tuple[int, int], int], positive: int) -> float:
        tp = counts.get((positive, positive), 0)
        fp = sum(n for (y, p), n in counts.items() if p == positive and y != positive)
        fn = sum(n for (y, p), n in counts.items() if p != positive and y == positive)
        return f1_from_counts(tp, fp, fn)


class OneClassModelValidator(UserModelValidator):
    """``predict`` gives 1 for true joins and -1 for others; the score is 0.5 plus
    ``decision_function`` (or, without one, ``score_samples``).  ``fold_f1_``: F1 of true
    joins on each held-out fold, with the bad joins of the same draws."""

    needs = ("fit", "predict", "score_samples")
    standard_behaviour = ONE_CLASS_STANDARD
    auto_descending = True

    def fit(self, parts: Mapping[str, DataFrame], number_of_k_fold: int = 5, num_batches_of_bad_joins: int = 1,
            seed: int | None = None) -> OneClassModelValidator:
        seed = self.seed if seed is None else seed
        self.features = feature_columns(parts)
        train = materialize(setup_training_data(parts, num_batches_of_bad_joins, seed=seed, negative_class=-1), "one-class")
        good, k = train.where(F.col("label") == 1), max(1, number_of_k_fold or 1)
        folded = kfold_assign(good, k, seed, id_col="j") if k > 1 else good.withColumn("fold", F.lit(-1))
        folded = materialize(folded, "folds")
        last = k if k > 1 else 0  # the group of the final model holds every fold
        groups = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda g: g != F.col("fold"))
        models = self._fit_groups(folded.withColumn("__g", F.explode(groups)))
        self.fold_f1_ = []
        if k > 1:
            bad = train.where(F.col("label") == -1).join(folded.select("j", "fold"), "j")
            test = folded.select(*self.features, "label", F.col("fold").alias("__g")).unionByName(bad.select(*self.features, "label", F.col("fold").alias("__g")))
            rated = self._apply(test, models, "predict", "__p", "__g")
            counts = self._fold_counts(rated.withColumn("__pred", F.when(F.col("__p") > 0, 1).otherwise(-1)))
            self.fold_f1_ = [self._f1(counts[g], 1) for g in sorted(counts)]
        self.model_ = {0: models[last]}
        self.pre_fit = True
        return self

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        method = "decision_function" if callable(getattr(self.model, "decision_function", None)) else "score_samples"
        return self._apply(df, self.model_, method, "__s").withColumn("score", F.lit(0.5) + F.col("__s")).drop("__s")


class OutlierModelValidator(UserModelValidator):
    """Fitted on true joins and a sixth of the bad ones; ``predict`` gives 0 (or a number
    below) for inliers and more for outliers, the score is 1 less ``decision_function``.
    ``fold_f1_``: macro F1 on each held-out part."""

    needs = ("fit", "predict", "decision_function")
    standard_behaviour = OUTLIER_STANDARD
    auto_descending = False

    def fit(self, parts: Mapping[str, DataFrame], number_of_k_fold: int = 5, num_batches_of_bad_joins: int = 2,
            seed: int | None = None) -> OutlierModelValidator:
        seed = self.seed if seed is None else seed
        self.features = feature_columns(parts)
        train = setup_training_data(parts, num_batches_of_bad_joins, seed=seed, negative_class=-1)
        data = materialize(subsample_negatives(train, seed, negative_class=-1), "outlier")
        k, rows, tests = number_of_k_fold or 0, data.withColumn("__g", F.lit(-1)), None
        for i in range(k):
            tr, te = holdout_split(data, k, seed + i)
            rows = rows.unionByName(tr.withColumn("__g", F.lit(i)))
            te = te.withColumn("__g", F.lit(i))
            tests = te if tests is None else tests.unionByName(te)
        models = self._fit_groups(rows)
        self.fold_f1_ = []
        if tests is not None:
            rated = self._apply(tests, models, "predict", "__p", "__g")
            counts = self._fold_counts(rated.withColumn("__pred", F.when(F.col("__p") > 0, -1).otherwise(1)))
            self.fold_f1_ = [(self._f1(counts[g], 1) + self._f1(counts[g], -1)) / 2 for g in sorted(counts)]
        self.model_ = {0: models[-1]}
        self.pre_fit = True
        return self

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return self._apply(df, self.model_, "decision_function", "__s").withColumn("score", F.lit(1.0) - F.col("__s")).drop("__s")
