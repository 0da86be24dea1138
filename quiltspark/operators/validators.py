"""Join validators (V1-V12): models that score a candidate row as plausible.

A validator exposes ``features`` (ordered column list, checked on use --
reference defect D17), ``score(df) -> df + score`` (higher = more plausible),
``auto_descending`` (order used by the auto threshold) and a
``standard_behaviour`` preset.  Models are MLlib pipelines; scoring is a
``transform`` (JVM side), never a Python row loop.
"""

from __future__ import annotations

import json
import logging
import math
import os
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltspark.functions.keys import key_to_long, seeded_key
from quiltspark.functions.mathx import sigmoid
from quiltspark.operators.joins import JoinBehaviour, feature_columns
from quiltspark.operators.positions import kth_value, value_position
from quiltspark.operators.sampling import setup_training_data
from quiltspark.session import materialize, spread

log = logging.getLogger(__name__)

# The reference's "standard" presets per validator family
# (patience, min_iter, max_iter, threshold, threshold_decay, auto_threshold_percentage).
#   classifier: 3, 5, 100, auto, 0,    0.1
#   one-class:  5, 5, 50,  auto, 0.01, 0.1
#   outlier:    5, 5, 50,  auto, 0.01, 0.1
CLASSIFIER_STANDARD = JoinBehaviour(3, 5, 100, "auto", 0.0, 0.1)
ONE_CLASS_STANDARD = JoinBehaviour(5, 5, 50, "auto", 0.01, 0.1)
OUTLIER_STANDARD = JoinBehaviour(5, 5, 50, "auto", 0.01, 0.1)


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    """Ordered columns to a vector; nulls become NaN instead of failing."""
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


class Validator:
    standard_behaviour: JoinBehaviour = CLASSIFIER_STANDARD
    auto_descending: bool = True
    features: list[str] | None = None
    pre_fit: bool = False

    def _check(self, df: DataFrame) -> None:
        missing = [c for c in (self.features or []) if c not in df.columns]
        if missing:
            raise ValueError(f"validator was trained on columns {self.features}; query lacks {missing}")

    def score(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def validate(self, df: DataFrame, threshold, auto_threshold_percentage: float = 0.1):
        """V5/V7/V9: score, resolve an ``auto`` threshold once, keep ``score >= t``.

        Returns ``(accepted, threshold)``.
        """
        scored = self.score(df)
        if threshold == "auto":
            scored = materialize(scored, "scored")  # for the count, the order statistic and the filter
            n = scored.count()
            threshold = kth_value(scored, "score", int(auto_threshold_percentage * n), descending=self.auto_descending)
        return scored.where(F.col("score") >= F.lit(threshold)), threshold


class LinearScoreValidator(Validator):
    """A fixed (pre-fitted) logistic scorer: ``sigmoid(bias + sum w*x)``.

    The score is rounded to ``digits`` decimals so that thresholds compare the
    same way in every engine.
    """

    def __init__(self, weights: Mapping[str, float], bias: float = 0.0, digits: int = 9):
        self.weights = dict(weights)
        self.bias = bias
        self.digits = digits
        self.features = list(self.weights)
        self.pre_fit = True

    def expression(self) -> Column:
        z = F.lit(float(self.bias))
        for c, w in self.weights.items():
            z = z + F.col(c).cast("double") * F.lit(float(w))
        return F.round(sigmoid(z), self.digits)

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return df.withColumn("score", self.expression())


def f1_from_counts(tp: int, fp: int, fn: int) -> float:
    return 0.0 if tp == 0 else 2 * tp / (2 * tp + fp + fn)


def confusion(df: DataFrame, label: str, pred: str, positive=1, weight: str | None = None) -> dict:
    """One grouped pass: tp, fp, fn, tn; with ``weight`` a row counts as so many rows."""
    w = F.lit(1) if weight is None else F.col(weight)
    r = df.agg(
        F.sum(((F.col(label) == positive) & (F.col(pred) == positive)).cast("long") * w).alias("tp"),
        F.sum(((F.col(label) != positive) & (F.col(pred) == positive)).cast("long") * w).alias("fp"),
        F.sum(((F.col(label) == positive) & (F.col(pred) != positive)).cast("long") * w).alias("fn"),
        F.sum(((F.col(label) != positive) & (F.col(pred) != positive)).cast("long") * w).alias("tn"),
    ).first()
    return {k: int(r[k] or 0) for k in ("tp", "fp", "fn", "tn")}


class ClassifierValidator(Validator):
    """V1-V5: binary classifier of good (1) vs bad (0) joins.

    Default model: random forest, 100 trees, depth 5.  ``param_grid`` runs a
    k-fold ``CrossValidator`` (V3); isotonic / sigmoid calibration (V4) is kept
    only if it strictly improves F1 on the training rows, as the reference does.
    """

    standard_behaviour = CLASSIFIER_STANDARD
    auto_descending = True

    def __init__(self, estimator=None, param_grid=None, calibration: str | None = "isotonic", seed: int = 0):
        self.estimator = estimator
        self.param_grid = param_grid
        self.calibration = calibration
        self.seed = seed
        self.model: PipelineModel | None = None
        self.calibrator = None
        self.calibrator_kind = None

    def _estimator(self):
        if callable(self.estimator):  # a backend that needs the number of features
            est = self.estimator(len(self.features))
        elif self.estimator is not None:
            est = self.estimator.copy()
        else:
            est = RandomForestClassifier(numTrees=100, maxDepth=5, seed=self.seed)
        return est.setFeaturesCol("features").setLabelCol("label")

    def fit(self, parts: Mapping[str, DataFrame], number_of_validation_folds: int = 2,
            num_batches_of_bad_joins: int = 2, seed: int | None = None) -> "ClassifierValidator":
        seed = self.seed if seed is None else seed
        self.features = feature_columns(parts)
        train = setup_training_data(parts, num_batches_of_bad_joins, seed=seed).withColumn(
            "label", F.col("label").cast("double")
        )
        # a good and a bad row share each j: their order is told, so that no layout of files decides it
        train = spread(materialize(train, "training"), "j").sortWithinPartitions("j", F.desc("label")).persist()
        est = self._estimator()
        pipe = Pipeline(stages=[assemble(self.features), est])
        if self.param_grid:
            from pyspark.ml.evaluation import BinaryClassificationEvaluator
            from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

            grid = ParamGridBuilder()
            for name, values in self.param_grid.items():
                grid = grid.addGrid(est.getParam(name), list(values))
            cv = CrossValidator(
                estimator=pipe,
                estimatorParamMaps=grid.build(),
                evaluator=BinaryClassificationEvaluator(labelCol="label"),
                numFolds=number_of_validation_folds,
                seed=seed,
                parallelism=2,
            )
            self.model = cv.fit(train).bestModel
        else:
            self.model = pipe.fit(train)
        raw = self._raw_scores(train)
        # rows of one score and label count as one, with how many they are: the rows are scored once
        own = getattr(self.model.stages[-1], "training_votes", None)  # a model that keeps its training rows has them counted
        counted = own() if own else raw.groupBy("__p", "label").agg(F.count(F.lit(1)).cast("double").alias("__w"))
        counted = materialize(counted, "counted")
        pre = confusion(counted.withColumn("pred", (F.col("__p") >= 0.5).cast("double")), "label", "pred", 1.0, "__w")
        f1_pre = f1_from_counts(pre["tp"], pre["fp"], pre["fn"])
        self.calibrator = None
        if self.calibration is not None:
            cal = self._fit_calibrator(raw, counted)
            post = confusion(
                self._apply_calibrator(cal, counted).withColumn("pred", (F.col("__cal") >= 0.5).cast("double")),
                "label", "pred", 1.0, "__w",
            )
            f1_post = f1_from_counts(post["tp"], post["fp"], post["fn"])
            if f1_post > f1_pre:
                self.calibrator = cal
                self.calibrator_kind = self.calibration
            log.info("calibration F1 %.4f -> %.4f", f1_pre, f1_post)
        self.train_f1_ = f1_pre
        train.unpersist()
        self.pre_fit = True
        return self

    def _raw_scores(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        if "probability" in out.columns:
            p = vector_to_array("probability")[1]
        else:  # a margin, as of a linear SVM; calibration (V4) may refine it
            p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        return out.withColumn("__p", p).drop("features", "rawPrediction", "probability", "prediction")

    def _fit_calibrator(self, raw: DataFrame, counted: DataFrame):
        if self.calibration == "isotonic":
            return IsotonicRegression(featuresCol="__p", labelCol="label", weightCol="__w", predictionCol="__cal").fit(counted)
        if self.calibration == "sigmoid":
            from pyspark.ml.classification import LogisticRegression

            lr_in = VectorAssembler(inputCols=["__p"], outputCol="__pv").transform(raw)
            return LogisticRegression(featuresCol="__pv", labelCol="label", probabilityCol="__cal_v").fit(lr_in)
        raise ValueError(f"unknown calibration {self.calibration!r}")

    def _apply_calibrator(self, cal, raw: DataFrame) -> DataFrame:
        if isinstance(cal, IsotonicRegressionModel):
            return cal.transform(raw)
        lr_in = VectorAssembler(inputCols=["__p"], outputCol="__pv").transform(raw)
        out = cal.transform(lr_in)
        return out.withColumn("__cal", vector_to_array("__cal_v")[1]).drop("__pv", "__cal_v", "rawPrediction", "prediction")

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        raw = self._raw_scores(df)
        if self.calibrator is None:
            return raw.withColumnRenamed("__p", "score")
        return self._apply_calibrator(self.calibrator, raw).drop("__p").withColumnRenamed("__cal", "score")

    # persistence
    def save(self, path: str) -> None:
        self.model.write().overwrite().save(os.path.join(path, "model"))
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(os.path.join(path, "calibrator"))
        state = {"features": self.features, "calibration": self.calibration, "calibrator_kind": self.calibrator_kind,
                 "seed": self.seed}
        spark_ctx = self.model.stages[0]  # noqa: F841 - model holds the session
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "state")
        )

    @classmethod
    def load(cls, path: str) -> "ClassifierValidator":
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        state = json.loads(spark.read.text(os.path.join(path, "state")).first()[0])
        v = cls(calibration=state["calibration"], seed=state["seed"])
        v.model = PipelineModel.load(os.path.join(path, "model"))
        v.features = state["features"]
        v.calibrator_kind = state["calibrator_kind"]
        if v.calibrator_kind == "isotonic":
            v.calibrator = IsotonicRegressionModel.load(os.path.join(path, "calibrator"))
        elif v.calibrator_kind == "sigmoid":
            from pyspark.ml.classification import LogisticRegressionModel

            v.calibrator = LogisticRegressionModel.load(os.path.join(path, "calibrator"))
        v.pre_fit = True
        return v


def classifier_backend(name: str, seed: int = 0):
    """The reference's classifier families mapped to MLlib estimators, for ``ClassifierValidator``."""
    from pyspark.ml import classification as C

    if name == "random_forest":
        return C.RandomForestClassifier(numTrees=100, maxDepth=5, seed=seed)
    if name == "gradient_boosting":
        return C.GBTClassifier(maxIter=100, maxDepth=3, seed=seed)
    if name == "logistic":
        return C.LogisticRegression(maxIter=100)
    if name == "mlp":
        return lambda n_features: mlp_backend(n_features, seed)
    if name == "linear_svm":  # no probability: the validator scores its margin
        return C.LinearSVC(maxIter=100)
    if name == "knn":
        from quiltspark.operators.knn import KNeighborsClassifier

        return KNeighborsClassifier(k=15)
    raise ValueError(f"unknown backend {name!r}")


def mlp_backend(n_features: int, seed: int = 0):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=[n_features, 100, 100, 2], seed=seed, maxIter=200)


# ---------------------------------------------------------------------------
# V6 / V7: one-class density validator (re-aimed one-class model)
# ---------------------------------------------------------------------------


#: MLlib's default tolerance, and how many rows a task of a mixture's step holds.
MIXTURE_TOLERANCE, ROWS_PER_BLOCK_TASK = 0.01, 100_000


def _normals(weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> list[tuple]:
    """Per component the weight, mean, root of the (pseudo-)inverse covariance and log scale of its density."""
    out = []
    for w, mu, cov in zip(weights, means, covs):
        values, vectors = np.linalg.eigh(cov)
        real = values > np.finfo(float).eps * values.max() * len(mu)
        if not real.any():
            raise ValueError("a mixture's covariance has no positive eigenvalue")
        root = vectors * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
        out.append((float(w), mu, root, -0.5 * (len(mu) * math.log(2 * math.pi) + float(np.log(values[real]).sum()))))
    return out


#: Rows of a block worked on together (what is worked out of them stays in the processor's cache).
ROWS_OF_A_STEP = 2048
#: Rows per component that MLlib's mixture starts from.
START_ROWS = 5


def _mixture_sums(models: Mapping[int, list[tuple]], d: int, pivot: np.ndarray):
    """Per mixture the log likelihood of the rows not in its fold and, per component, the sums of
    responsibility, of the rows and of their products, both about ``pivot``.

    A block's rows lie by fold: the components of all mixtures that take a fold's rows are worked
    out by one product, and so are their sums."""
    names, eps = list(models), np.finfo(float).eps
    at, size = np.triu_indices(d), len(next(iter(models.values())))

    def taking(fold):
        """Places of the mixtures that take the fold's rows, and their components in one."""
        own = [i for i, m in enumerate(names) if m != fold]
        comps = [c for i in own for c in models[names[i]]]
        if not comps:
            return None
        root = np.concatenate([c[2].T for c in comps])
        return own, root, np.concatenate([(c[1] - pivot) @ c[2] for c in comps])[:, None], *(np.array([c[j] for c in comps])[:, None] for j in (0, 3))

    def run(batches):
        total = np.zeros((len(names), 1 + size * (1 + d + len(at[0]))))
        of: dict[int, tuple | None] = {}
        for batch in batches:
            for raw, marks in zip(batch.column("x").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                x, fold = np.frombuffer(raw).reshape(-1, d).T - pivot[:, None], np.frombuffer(marks, np.int32)
                ends = [0, *(np.flatnonzero(fold[1:] != fold[:-1]) + 1).tolist(), len(fold)]
                for begin, end in zip(ends[:-1], ends[1:], strict=True):
                    if begin == end:
                        continue
                    f = int(fold[begin])
                    if f not in of:
                        of[f] = taking(f)
                    if of[f] is None:
                        continue
                    own, root, middle, w, scale = of[f]
                    for low in range(begin, end, ROWS_OF_A_STEP):
                        z = x[:, low : min(end, low + ROWS_OF_A_STEP)]
                        n = z.shape[1]
                        p = np.square(root @ z - middle).reshape(-1, d, n).sum(1)
                        p *= -0.5
                        p += scale
                        np.exp(p, out=p)
                        p *= w
                        p += eps
                        p = p.reshape(len(own), size, n)
                        whole = p.sum(1)
                        p /= whole[:, None]
                        parts = np.concatenate((np.ones((1, n)), z, z[at[0]] * z[at[1]]))
                        total[own, 0] += np.log(whole).sum(1)
                        total[own, 1:] += (p.reshape(-1, n) @ parts.T).reshape(len(own), -1)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


class DensityValidator(Validator):
    """Trained on true joins only: a Gaussian mixture's log density, shifted so
    that the ``nu`` quantile of the training rows sits at 0 (``decision``);
    the score is ``0.5 + decision`` as in the reference.

    The log density is a closed-form Column expression of the fitted
    parameters (quadratic forms + log-sum-exp), so scoring stays JVM-side.
    """

    standard_behaviour = ONE_CLASS_STANDARD
    auto_descending = True

    def __init__(self, k: int = 2, nu: float = 0.5, seed: int = 0, max_iter: int = 100):
        self.k, self.nu, self.seed, self.max_iter = k, nu, seed, max_iter

    def _start(self, pos: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, means and covariances that MLlib's mixture starts from on these rows: it draws five
        rows a component with the seed, and takes their means and variances."""
        rows = pos.select(*[F.col(f"`{c}`").cast("double") for c in self.features])
        drawn = rows._jdf.javaRDD().takeSample(True, self.k * START_ROWS, self.seed)
        if not len(drawn):
            raise ValueError("a mixture needs rows")
        x = np.array([[np.nan if r.isNullAt(i) else r.getDouble(i) for i in range(len(self.features))] for r in drawn])
        groups = x.reshape(self.k, START_ROWS, -1)
        return np.full(self.k, 1 / self.k), groups.mean(1), np.array([np.diag(g.var(0)) for g in groups])

    def _fit_mixtures(self, rows: DataFrame, starts: Mapping[int, tuple]) -> dict[int, list]:
        """One mixture per key of ``starts``, fitted to the ``rows`` of any other ``fold``.

        Expectation maximisation by MLlib's rules (its start, ``p + eps``, stop at a change of the log
        likelihood of at most 0.01); a step is one job over the rows' blocks for all mixtures that
        have not stopped, and only their sums come to the driver."""
        feats = list(self.features)
        d = len(feats)

        def blocked(batches):
            for batch in batches:
                x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in feats])
                fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int32)
                order = np.argsort(fold, kind="stable")
                yield pa.record_batch([pa.array([np.ascontiguousarray(x[order], float).tobytes()], pa.binary()),
                                       pa.array([fold[order].tobytes()], pa.binary())], ["x", "fold"])

        blocks = rows.select("fold", *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
        blocks = materialize(blocks.mapInArrow(blocked, "x binary, fold binary"), "mixture-rows")
        upper = np.triu_indices(d)
        now, gone, likely = dict(starts), {}, dict.fromkeys(starts, (-float(np.finfo(float).max), 0.0))
        for _ in range(self.max_iter):
            going = {m: _normals(*now[m]) for m in now if m not in gone}
            if not going:
                break
            pivot = np.mean([mu for m in going for _, mu, _, _ in going[m]], axis=0)
            found = blocks.mapInArrow(_mixture_sums(going, d, pivot), "sums binary").collect()  # a row per task
            sums = sum(np.frombuffer(r["sums"]) for r in found).reshape(len(going), -1)
            if not np.isfinite(sums).all():
                raise ValueError("a mixture can't be fitted to rows with null, NaN or infinite values")
            for m, s in zip(going, sums, strict=True):
                per = s[1:].reshape(self.k, -1)
                weight, mean = per[:, 0], per[:, 1 : 1 + d] / per[:, :1]
                cov = np.empty((self.k, d, d))
                cov[:, upper[0], upper[1]] = cov[:, upper[1], upper[0]] = per[:, 1 + d :] / weight[:, None]
                now[m] = (weight / weight.sum(), mean + pivot, cov - mean[:, :, None] * mean[:, None, :])
                likely[m] = (float(s[0]), likely[m][0])
                if not abs(likely[m][0] - likely[m][1]) > MIXTURE_TOLERANCE:
                    gone[m] = True
        return {m: self._components(*model) for m, model in now.items()}

    @staticmethod
    def _components(weights, means, covs) -> list:
        comps = []
        for w, mu, cov in zip(weights, means, covs):
            cov = cov + 1e-9 * np.eye(len(mu))
            prec = np.linalg.inv(cov)
            _, logdet = np.linalg.slogdet(cov)
            comps.append((math.log(max(w, 1e-300)), mu, prec, logdet))
        return comps

    def _logdensity(self, comps) -> Column:
        return self._density([[(logw, mu, prec, logdet)] for logw, mu, prec, logdet in comps], lambda xs: F.lit(float(xs[0])))

    def _fold_logdensity(self, fitted: list[list]) -> Column:
        """The log density by the mixture that a row's ``fold`` names: one expression, its numbers looked up."""
        return self._density([list(c) for c in zip(*fitted, strict=True)], lambda xs: F.array(*[F.lit(float(x)) for x in xs])[F.col("fold")])

    def _density(self, comps: list[list[tuple]], number) -> Column:
        """``comps``: per component its (log weight, mean, precision, log determinant) in each of some mixtures;
        ``number`` makes a column of what a number is in each of them."""
        d = len(self.features)
        terms = []
        for some in comps:
            diffs = [F.col(f"`{c}`").cast("double") - number([mu[a] for _, mu, _, _ in some]) for a, c in enumerate(self.features)]
            quad = F.lit(0.0)
            for a in range(d):
                for b in range(d):
                    if any(prec[a, b] != 0.0 for _, _, prec, _ in some):
                        quad = quad + number([prec[a, b] for _, _, prec, _ in some]) * diffs[a] * diffs[b]
            terms.append(number([logw - 0.5 * logdet - 0.5 * d * math.log(2 * math.pi) for logw, _, _, logdet in some]) - F.lit(0.5) * quad)
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        return top + F.log(sum((F.exp(t - top) for t in terms), F.lit(0.0)))

    def _offset(self, comps, pos: DataFrame) -> float:
        n = pos.count()
        scored = pos.select(self._logdensity(comps).alias("__ld"))
        return kth_value(scored, "__ld", min(int(self.nu * n), n - 1))

    def fit(self, parts: Mapping[str, DataFrame], number_of_k_fold: int = 5, num_batches_of_bad_joins: int = 1,
            seed: int | None = None) -> "DensityValidator":
        seed = self.seed if seed is None else seed
        self.features = feature_columns(parts)
        train = setup_training_data(parts, num_batches_of_bad_joins, seed=seed, negative_class=-1)
        pos = train.where(F.col("label") == 1).persist()
        neg = train.where(F.col("label") == -1)
        k = number_of_k_fold if number_of_k_fold and number_of_k_fold > 1 else 0
        if k:
            from quiltspark.operators.sampling import kfold_assign

            folded = kfold_assign(pos, k, seed, id_col="j").persist()
        else:
            folded = pos.withColumn("fold", F.lit(-1))  # in no mixture's fold
        # mixture f leaves fold f out, mixture k none
        starts = {f: self._start(folded.where(F.col("fold") != f)) for f in range(k)} | {k: self._start(pos)}
        dealt = folded.select("j", "fold", *self.features).repartition(max(1, -(-pos.count() // ROWS_PER_BLOCK_TASK)), "j")
        rows = materialize(dealt.sortWithinPartitions("j"), "folds")
        fitted = self._fit_mixtures(rows, starts)
        offsets = {f: self._offset(fitted[f], rows.where(F.col("fold") != f)) for f in range(k)} | {k: self._offset(fitted[k], rows)}
        self.fold_f1_ = []
        if k:
            # the bad joins of a fold are those numbered like its true ones
            bad = neg.join(rows.select("j", "fold").distinct(), "j").select("fold", *self.features, F.lit(-1).alias("label"))
            test = rows.select("fold", *self.features, F.lit(1).alias("label")).unionByName(bad)
            cut = F.array(*[F.lit(float(offsets[f])) for f in range(k)])[F.col("fold")]
            inlier = self._fold_logdensity([fitted[f] for f in range(k)]) >= cut
            good, is_true = F.coalesce(inlier, F.lit(False)), F.col("label") == 1
            hits = test.groupBy("fold").agg(F.count(F.when(good & is_true, 1)).alias("tp"), F.count(F.when(good & ~is_true, 1)).alias("fp"),
                                            F.count(F.when(~good & is_true, 1)).alias("fn"))
            found = {r["fold"]: f1_from_counts(r["tp"], r["fp"], r["fn"]) for r in hits.collect()}  # a row a fold
            self.fold_f1_ = [found.get(f, 0.0) for f in range(k)]
            folded.unpersist()
        self.components, self.offset_ = fitted[k], offsets[k]
        pos.unpersist()
        self.pre_fit = True
        return self

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return df.withColumn("score", F.lit(0.5) + self._logdensity(self.components) - F.lit(self.offset_))


# ---------------------------------------------------------------------------
# V8 / V9: isolation forest as a Spark job
# ---------------------------------------------------------------------------


def _avg_path(n):
    """Average unsuccessful-search path length c(n) of a binary search tree."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _build_tree(pdf, features, height_limit, seed):
    """One isolation tree from its subsample (pandas in, node table out)."""
    import pandas as pd

    t = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng([seed, t])
    x = pdf[features].to_numpy(dtype=float)
    nodes = []  # (node, feature, split, left, right, size)

    def grow(idx, depth):
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx)])
        if depth >= height_limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return me
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < s]
        right = idx[sub[:, f] >= s]
        nodes[me][1], nodes[me][2] = f, s
        nodes[me][3] = grow(left, depth + 1)
        nodes[me][4] = grow(right, depth + 1)
        return me

    grow(np.arange(len(x)), 0)
    return pd.DataFrame([[t, *n] for n in nodes], columns=["tree", "node", "feature", "split", "left", "right", "size"])


#: So many rows go down a tree together (their nodes stay in the processor's cache).
ROWS_DOWN_A_TREE = 8192


def _walked(feature, split, left, right, size) -> tuple:
    """A tree for walking down it without asking where it ends: a leaf's children are itself.  Per node the
    feature, the split and both children; the number of steps to the deepest leaf; per leaf the path length."""
    leaf, depth = feature < 0, np.zeros(len(feature))
    for node in range(len(feature)):  # children come after their parent
        if not leaf[node]:
            depth[[left[node], right[node]]] = depth[node] + 1
    own = np.arange(len(feature))
    child = np.column_stack([np.where(leaf, own, left), np.where(leaf, own, right)]).astype(np.intp).ravel()
    return np.where(leaf, 0, feature).astype(np.intp), np.asarray(split, float), child, int(depth.max()), depth + _avg_path(size)


class IsolationForestValidator(Validator):
    """Isolation forest on true joins plus 1/6 of the bad joins (contamination 0.25).

    Trees: every tree's 256-row subsample is the rows with the smallest seeded
    hash for that tree (pre-filtered to ~4x256 candidates per tree, so no
    group ever holds more than a bounded sample); ``groupBy(tree).applyInPandas``
    grows the trees of all folds and of the final forest; the node tables (<=
    forests x trees x 511 rows) are broadcast and path lengths are computed
    batch-wise with ``mapInPandas``.
    Score = ``1 - (anomaly - offset)``, higher = more inlier; the auto
    threshold sorts ascending, as the reference does (defect D6).
    """

    standard_behaviour = OUTLIER_STANDARD
    auto_descending = False

    def __init__(self, n_trees: int = 100, sample_size: int = 256, contamination: float = 0.25, seed: int = 0):
        self.n_trees, self.sample_size, self.contamination, self.seed = n_trees, sample_size, contamination, seed

    def _subsamples(self, data: DataFrame, sizes: Mapping[int, int]) -> DataFrame:
        """For every forest ``__forest`` and tree the rows with the smallest hash; trees are numbered through all forests."""
        factor, trees, spark = 4.0, self.n_trees, data.sparkSession
        want = spark.createDataFrame([(g * trees + t, min(self.sample_size, n)) for g, n in sizes.items() for t in range(trees)],
                                     "tree int, m int")  # forests x trees rows
        while True:
            share = {g: min(1.0, factor * min(self.sample_size, n) / max(n, 1)) for g, n in sizes.items()}
            thr = F.create_map(*[F.lit(x) for g, u in share.items() for x in (g, u)])[F.col("__forest")]
            u = F.xxhash64(F.lit(self.seed), F.col("tree"), F.col("j")).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
            # a row per tree, dropped in the same compiled loop: higher-order functions would be interpreted
            drawn = data.withColumn("__share", thr).select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("__t"))
            drawn = drawn.withColumn("tree", (F.col("__forest") * trees + F.col("__t")).cast("int")).withColumn("u", u)
            cand = drawn.where(F.col("u") < F.col("__share")).drop("__share", "__t")
            w = Window.partitionBy("tree").orderBy("u", "j", *self.features)
            picked = cand.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= self.sample_size).drop("__r").persist()
            had = picked.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
            short = want.join(had, "tree", "left").where(F.coalesce("n", F.lit(0)) < F.col("m")).limit(1).count()
            if not short or min(share.values()) >= 1.0:
                return picked
            picked.unpersist()
            factor *= 4

    def _grow(self, data: DataFrame, sizes: Mapping[int, int]) -> dict[int, tuple]:
        """All forests of ``data`` (j, features, ``__forest``) in one grouped job: ``{__forest: (forest, psi)}``."""
        feats, trees, seed = list(self.features), self.n_trees, self.seed
        limits = {g: int(math.ceil(math.log2(max(min(self.sample_size, n), 2)))) for g, n in sizes.items()}
        sub = self._subsamples(data.select("j", "__forest", *feats), sizes)
        schema = "tree int, node int, feature int, split double, left int, right int, size long"
        grown = sub.groupBy("tree").applyInPandas(lambda pdf: _build_tree(pdf, feats, limits[int(pdf["__forest"].iloc[0])], seed), schema)
        nodes = grown.collect()  # <= forests x n_trees x (2*256 - 1) rows
        sub.unpersist()
        rows: dict[int, list] = {}
        for r in nodes:
            rows.setdefault(r["tree"], []).append(r)
        forests: dict[int, list] = {g: [] for g in sizes}
        for t in sorted(rows):
            tree = sorted(rows[t], key=lambda r: r["node"])
            forests[t // trees].append(tuple(np.array([getattr(r, k) for r in tree]) for k in ("feature", "split", "left", "right", "size")))
        return {g: (forest, min(self.sample_size, sizes[g])) for g, forest in forests.items()}

    def _anomaly(self, df: DataFrame, out: str = "__anom", forests: Mapping[int, tuple] | None = None) -> DataFrame:
        """Anomaly by the fitted forest, or by that of ``forests`` which a row's ``__forest`` names."""
        feats, grouped = list(self.features), forests is not None
        used = dict(forests) if grouped else {0: (self.forest, self.psi)}
        bc = df.sparkSession.sparkContext.broadcast({g: ([_walked(*tree) for tree in forest], psi) for g, (forest, psi) in used.items()})

        def anomalies(x, forest, psi):
            total = np.zeros(len(x))
            for at in range(0, len(x), ROWS_DOWN_A_TREE):
                some = np.ascontiguousarray(x[at : at + ROWS_DOWN_A_TREE].T).ravel()
                n = len(some) // x.shape[1]
                row = np.arange(n)
                for start, split, child, steps, length in forest:
                    node = np.zeros(n, dtype=np.intp)
                    for _ in range(steps):
                        left = some.take(start.take(node) * n + row) < split.take(node)
                        node = child.take(2 * node + ~left)
                    total[at : at + n] += length.take(node)
            return np.power(2.0, -(total / len(forest)) / float(_avg_path([psi])[0]))

        def score_batches(it):
            for pdf in it:
                x = pdf[feats].to_numpy(dtype=float)
                which = pdf["__forest"].to_numpy() if grouped else np.zeros(len(x), dtype=int)
                found = np.zeros(len(x))
                for g in np.unique(which):
                    found[which == g] = anomalies(x[which == g], *bc.value[int(g)])
                pdf[out] = found
                yield pdf

        schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
        return df.mapInPandas(score_batches, schema)

    def _folds(self, data: DataFrame, k: int, seed: int) -> DataFrame:
        """``data`` once per forest: ``__forest`` 0 trains on all rows, ``__forest`` i on all but the i-th hold-out
        (per class the ``ceil(n_c / k)`` rows of smallest key, as M6 with ``seed + i - 1``); ``__test`` marks those."""
        per_class = {r["label"]: -(-r["n"] // k) if k else 0 for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        g = F.explode(F.sequence(F.lit(0), F.lit(k)))
        rows = data.select("j", "label", *self.features, g.alias("__forest"))
        if not k:
            return rows.withColumn("__test", F.lit(False))
        key = None
        for i in range(1, k + 1):
            for c in per_class:
                here = F.when((F.col("__forest") == i) & (F.col("label") == c), key_to_long(seeded_key(seed + i - 1, f"holdout:{c}", "j")))
                key = here if key is None else F.coalesce(key, here)
        held = value_position(rows.where("__forest > 0").withColumn("__h", key).withColumn("__gc", F.concat_ws("|", "__forest", "label")),
                              ["__h", "j"], out="__pos", partition_col="__gc").drop("__h", "__gc")
        n_test = F.create_map(*[F.lit(x) for c, m in per_class.items() for x in (c, m)])[F.col("label")]
        held = held.withColumn("__test", F.col("__pos") < n_test).drop("__pos")
        return rows.where("__forest = 0").withColumn("__test", F.lit(False)).unionByName(held)

    def fit(self, parts: Mapping[str, DataFrame], number_of_k_fold: int = 5, num_batches_of_bad_joins: int = 2,
            seed: int | None = None) -> "IsolationForestValidator":
        """The trees of all folds and of the final forest grow in one job; one more scores every row
        with each of them; the cut of each is an order statistic of its training scores, one job counts the folds' hits."""
        from quiltspark.operators.sampling import subsample_negatives

        seed, k = self.seed if seed is None else seed, number_of_k_fold or 0
        if k == 1:
            raise ValueError("one fold would hold out every row")
        self.features = feature_columns(parts)
        # written once: the bad joins are counted, cut by an order statistic and read again
        train = materialize(setup_training_data(parts, num_batches_of_bad_joins, seed=seed, negative_class=-1), "training")
        data = subsample_negatives(train, seed, negative_class=-1)
        rows = materialize(self._folds(materialize(data, "outliers"), k, seed), "folds")
        fitted = rows.where("not __test")
        sizes = {r["__forest"]: r["n"] for r in fitted.groupBy("__forest").agg(F.count(F.lit(1)).alias("n")).collect()}
        forests = self._grow(fitted, sizes)
        scored = materialize(self._anomaly(rows, forests=forests).select("j", "__forest", "label", "__test", "__anom"), "anomalies")
        kept = scored.where("not __test")
        cuts = {g: kth_value(kept.where(F.col("__forest") == g), "__anom", min(int((1 - self.contamination) * n), n - 1)) for g, n in sizes.items()}
        self.fold_f1_ = []
        if k:
            cut = F.create_map(*[F.lit(x) for g, c in cuts.items() for x in (g, c)])[F.col("__forest")]
            inlier, is_true = F.col("__anom") <= cut, F.col("label") == 1
            hits = scored.where("__test").groupBy("__forest").agg(
                F.count(F.when(inlier & is_true, 1)).alias("tp"), F.count(F.when(inlier & ~is_true, 1)).alias("fp"),
                F.count(F.when(~inlier & is_true, 1)).alias("fn"), F.count(F.when(~inlier & ~is_true, 1)).alias("tn"))
            for r in sorted(hits.collect()):  # macro F1 with like labels (reference defect D9)
                self.fold_f1_.append((f1_from_counts(r["tp"], r["fp"], r["fn"]) + f1_from_counts(r["tn"], r["fn"], r["fp"])) / 2)
        self.forest, self.psi = forests[0]
        self.offset_ = cuts[0]  # above it lies the ``contamination`` share of the training rows
        self.pre_fit = True
        return self

    def score(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return self._anomaly(df).withColumn("score", F.lit(1.0) - (F.col("__anom") - F.lit(self.offset_))).drop("__anom")


# ---------------------------------------------------------------------------
# Sample-space projection
# ---------------------------------------------------------------------------


def sample_space_projection(validator: Validator, train: DataFrame, holdout: DataFrame, label: str = "label") -> DataFrame:
    """PCA(2) fitted on the centred training features, applied to train and
    holdout, with the label and the validator's score."""
    from pyspark.ml.feature import PCA, StandardScaler

    feats = list(validator.features)
    va = assemble(feats, "__x")
    tr = va.transform(train)
    scaler = StandardScaler(inputCol="__x", outputCol="__c", withMean=True, withStd=False).fit(tr)
    pca = PCA(k=2, inputCol="__c", outputCol="__pc").fit(scaler.transform(tr))
    out = None
    for name, df in (("train", train), ("holdout", holdout)):
        scored = validator.score(df)
        proj = pca.transform(scaler.transform(va.transform(scored)))
        arr = vector_to_array("__pc")
        piece = proj.select(F.lit(name).alias("set"), arr[0].alias("pc1"), arr[1].alias("pc2"),
                            F.col(label).alias("label"), F.col("score").alias("prob"))
        out = piece if out is None else out.unionByName(piece)
    return out
