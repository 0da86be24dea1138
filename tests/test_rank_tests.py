"""p values, ties, small numbers of blocks; A8: both sets."""

import itertools
import math

import pytest

from quiltspark.operators import stats as S
from quiltspark.operators.aggregates import calibration_pair


def _ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def test_signed_ranks_exact_and_tied(spark):
    a = [3.0, 5.5, 9.0, 1.0, 4.0, 8.0, None]
    b = [1.0, 6.0, 2.0, 1.0, 1.0, 3.0, 2.0]
    c = [1.0, 3.5, 7.0, 3.0, 2.0, 8.0, 2.0]  # a - c: ties and a zero
    wide = spark.createDataFrame(list(zip(range(7), a, b, c)), "rep int, A double, B double, C double")
    got = {(r["model_a"], r["model_b"]): r for r in S.wilcoxon_pairs(wide, ["A", "B", "C"], ties=True).collect()}
    p = {(r["model_a"], r["model_b"]): r for r in S.pairwise_test(wide, ["A", "B", "C"]).collect()}
    cols = dict(A=a, B=b, C=c)
    for x, y in itertools.combinations("ABC", 2):
        d = [u - v for u, v in zip(cols[x], cols[y]) if u is not None and v is not None and u != v]
        r = _ranks([abs(v) for v in d])
        plus = sum(k for k, v in zip(r, d) if v > 0)
        assert got[x, y]["w_plus"] == plus and got[x, y]["w_minus"] == sum(r) - plus and got[x, y]["n"] == len(d)
        ties = sum(r.count(k) ** 2 - 1 for k in r)  # t * (t^2 - 1) over each group
        assert got[x, y]["tie_sum"] == ties
        if not ties:
            sums = [sum(k for k, s in zip(r, signs) if s) for signs in itertools.product((0, 1), repeat=len(d))]
            low, high = sum(s <= plus for s in sums) / len(sums), sum(s >= plus for s in sums) / len(sums)
            assert p[x, y]["p_value"] == pytest.approx(min(1.0, 2 * min(low, high)))
        else:
            n = len(d)
            z = (min(plus, sum(r) - plus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
            assert p[x, y]["p_value"] == pytest.approx(1 + math.erf(z / math.sqrt(2)), abs=1e-6)


def test_corrections_and_alternatives():
    rows = [dict(model_a="a", model_b=m, w_plus=w, w_minus=55.0 - w, n=10) for m, w in (("b", 2.0), ("c", 10.0), ("d", 27.0))]
    less = {r["model_b"]: r for r in S.holm_wilcoxon(rows, 0.1, "less", "none")}
    assert less["b"]["p"] == pytest.approx(3 / 1024)  # sums 0, 1 and 2
    assert S.holm_wilcoxon(rows[:1], 0.1, "greater")[0]["p"] == pytest.approx(1 - 2 / 1024)
    holm = S.holm_wilcoxon(rows)
    assert [r["p_holm"] for r in holm] == [3 * holm[0]["p"], 2 * holm[1]["p"], pytest.approx(max(2 * holm[1]["p"], holm[2]["p"]))]
    assert all(r["p_corrected"] == min(1.0, 3 * r["p"]) for r in S.holm_wilcoxon(rows, correction="bonferroni"))
    assert S.holm_wilcoxon([]) == [] and S.holm_wilcoxon([dict(rows[0], n=0, w_plus=0.0, w_minus=0.0)])[0]["p"] == 1.0
    for bad in (dict(alternative="up"), dict(correction="other")):
        with pytest.raises(ValueError):
            S.holm_wilcoxon(rows, **bad)


def test_friedman_p_and_ties(spark):
    rows = [("x", i, float(i % 3)) for i in range(9)] + [("y", i, 5.0 + i) for i in range(9)] + [("z", i, 5.0 + i) for i in range(9)]
    stat, p = S.friedman_test(spark.createDataFrame(rows, "model string, rep int, value double"), ["rep"])
    assert stat == pytest.approx(18.0) and p == pytest.approx(math.exp(-9.0))
    same = spark.createDataFrame([(m, i, 1.0) for m in "xyz" for i in range(4)], "model string, rep int, value double")
    assert all(math.isnan(v) for v in S.friedman_test(same, ["rep"]))


def test_calibration_of_both_sets(spark):
    mk = lambda rows: spark.createDataFrame(rows, "score double, label int")
    got = {(r["k"], r["bin"]): (r["mean_pred"], r["frac_pos"], r["n"]) for r in calibration_pair(
        mk([(0.1, 0), (0.05, 1), (0.95, 1)]), mk([(0.95, 0), (None, 1)])).collect()}
    assert got == {(1, 0): (0.075, 0.5, 2), (1, 9): (0.95, 1.0, 1), (2, 9): (0.95, 0.0, 1), (2, None): (None, 1.0, 1)}
