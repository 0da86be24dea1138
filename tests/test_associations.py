"""The association matrix and the counting cube against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quiltspark.operators.generators.bayes_net import BayesNet
from quiltspark.operators.metrics import association_matrix


def rows_of(n=400):
    rng = random.Random(6)
    out = []
    for _ in range(n):
        a = rng.choice(["x", "y", None])
        b = {"x": 1, "y": 2, None: 3}[a] if rng.random() < 0.6 else rng.randrange(4)
        u = 1e6 + (b or 0) + rng.random()
        out.append((a, b, None if rng.random() < 0.1 else u, rng.gauss(0, 1) + u * 1e-1, "same"))
    return out


def brute(rows, kinds):
    d = len(kinds)
    m = np.eye(d)
    for i in range(d):
        for j in range(i + 1, d):
            x, y = [r[i] for r in rows], [r[j] for r in rows]
            if kinds[i] == kinds[j] == "n":
                p = np.array([(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None])
                v = np.corrcoef(p.T)[0, 1]
            elif kinds[i] == "c" and kinds[j] == "n":
                p = [(u, w) for u, w in zip(x, y, strict=True) if w is not None]
                mu = np.mean([w for _, w in p])
                groups = {}
                for u, w in p:
                    groups.setdefault(u, []).append(w)
                between = sum(len(g) * (np.mean(g) - mu) ** 2 for g in groups.values())
                v = math.sqrt(between / sum((w - mu) ** 2 for _, w in p))
            else:
                n, cells, ca, cb = len(rows), Counter(zip(x, y, strict=True)), Counter(x), Counter(y)
                k = min(len(ca), len(cb))
                v = math.sqrt(max(0.0, (sum(o * o / (ca[u] * cb[w]) for (u, w), o in cells.items()) - 1) / (k - 1))) if k > 1 else 0.0
            m[i, j] = m[j, i] = v
    return m


def test_association_matrix_matches_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(r[0], r[1], r[4], r[2], r[3]) for r in rows], "a string, b int, e string, u double, v double")
    cols, m = association_matrix(df, ["a", "b", "e"], ["u", "v"])
    want = brute([(r[0], r[1], r[4], r[2], r[3]) for r in rows], "cccnn")
    assert cols == ["a", "b", "e", "u", "v"] and m == pytest.approx(want, abs=1e-8)
    assert association_matrix(df.limit(0), ["a", "b"], ["u"])[1] == pytest.approx(np.eye(3))
    assert association_matrix(df, [], ["u", "v"])[1][0, 1] == pytest.approx(want[3, 4])


def test_scores_from_the_cube_are_those_of_the_rows(spark, monkeypatch):
    rows = [(i, i % 3, (i % 3 + i // 7) % 4, i * i % 5, (i * 3 + i // 11) % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "__row_id long, a long, b long, c long, d long")
    asked = []
    original = BayesNet.mutual_information
    monkeypatch.setattr(BayesNet, "mutual_information", lambda self, t, c: asked.append((t.count(), list(c))) or original(self, t, c))
    net = BayesNet(k=1, seed=3).fit(df)
    assert all(n == len({r[1:] for r in rows}) for n, _ in asked)  # the cube, not the rows
    every = [c for _, some in asked for c in some]
    assert len(every) == len(set(every))  # nothing is scored twice

    def mi(x, p):
        j, cx, cp = Counter((r[x], r[p]) for r in rows), Counter(r[x] for r in rows), Counter(r[p] for r in rows)
        return sum(n / 300 * math.log(n * 300 / (cx[u] * cp[w])) for (u, w), n in j.items())

    names = ["__row_id", "a", "b", "c", "d"]
    visited = [net.network[0][0]]
    for x, (p,) in net.network[1:]:
        best = max(mi(names.index(y), names.index(q)) for y in names[1:] if y not in visited for q in visited)
        assert mi(names.index(x), names.index(p)) == pytest.approx(best)
        visited.append(x)
