"""One-class and outlier validators around toy models of a user."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltspark.operators import joins as J
from quiltspark.operators import user_models as X


class Centre:
    """Far from the mean of |x - y| is odd."""

    rows = None

    def fit(self, x):
        self.rows = len(x)
        gap = np.abs(x[:, 0] - x[:, 1])
        self.cut = float(np.quantile(gap, 0.9)) + 1e-9
        return self

    def odd(self, x):
        return np.abs(x[:, 0] - x[:, 1]) / self.cut - 1


class OneClass(Centre):
    def predict(self, x):
        return np.where(self.odd(x) <= 0, 1, -1)

    def score_samples(self, x):
        return -self.odd(x)


class Outlier(Centre):
    def predict(self, x):
        return (self.odd(x) > 0).astype(int)

    def decision_function(self, x):
        return self.odd(x)


@pytest.fixture(scope="module")
def parts(spark):
    base = spark.range(400).select(F.col("id").alias("__row_id"), (F.col("id") / 400).alias("x"), (F.col("id") / 400 + F.col("id") % 7 / 1000).alias("y"))
    return {"a": base.select("__row_id", "x"), "b": base.select("__row_id", "y")}


def test_models_are_checked_when_given():
    with pytest.raises(X.UnsuitableModel, match="score_samples"):
        X.OneClassModelValidator(Outlier())
    with pytest.raises(ValueError, match="decision_function"):
        X.OutlierModelValidator(OneClass())
    with pytest.raises(X.UnsuitableModel, match="fit or predict"):
        X.OutlierModelValidator(object())


@pytest.mark.parametrize("kind,model", [(X.OneClassModelValidator, OneClass()), (X.OutlierModelValidator, Outlier())])
def test_user_models_score_like_themselves(spark, parts, kind, model):
    v = kind(model, seed=4, fit_rows=150).fit(parts, number_of_k_fold=3)
    assert len(v.fold_f1_) == 3 and min(v.fold_f1_) > 0.6
    scored = v.score(J.random_join(parts, 5)).collect()
    import pickle

    fitted = pickle.loads(v.model_[0])
    assert 0 < fitted.rows < 300  # a bounded sample
    x = np.array([[r["x"], r["y"]] for r in scored])
    want = 0.5 + fitted.score_samples(x) if kind is X.OneClassModelValidator else 1 - fitted.decision_function(x)
    assert [r["score"] for r in scored] == pytest.approx(want.tolist()) and len(scored) == 400
    assert v.score(J.random_join(parts, 5).limit(0)).count() == 0
    out = J.ValidatedJoin(v, behaviour="standard", seed=1, max_iter=2, threshold=0.5).join(parts)
    assert 0 < out.count() <= 400


def test_a_large_model_is_refused(parts):
    with pytest.raises(Exception, match="ModelTooLarge"):
        X.OneClassModelValidator(OneClass(), max_model_bytes=10).fit(parts, number_of_k_fold=0)
