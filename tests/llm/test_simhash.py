import collections
import random

import numpy as np
import xxhash

from quiltspark.llm import simhash


def brute_print(text):
    w = (text or "").encode().lower().split()
    some = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """{id: (component, links)} over rows with ids; repeated ids are one node."""
    prints = [(i, brute_print(t)) for i, t in rows if i is not None]
    up, count = {i: i for i, _ in prints}, collections.Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(prints):
        for m, (j, b) in enumerate(prints[:k]):
            if (a ^ b).bit_count() <= 3:
                count[k] += 1
                count[m] += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return collections.Counter((i, f"{p:016x}", find(i), count[k]) for k, (i, p) in enumerate(prints))


def corpus(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"v{rng.randrange(2000)}" for _ in range(rng.choice([1, 2, 3, 5, 40, 300, 900]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = list(base)
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out + out[:5]))


def ball(rng, n, spread):
    """Fingerprints that differ from a few centres in up to ``spread`` bits."""
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread + 1)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def found_pairs(fp, cuts):
    """All pairs over the keys of every path with so many cuts."""
    paths = [simhash.Path(k) for k in range(4)]
    for _ in range(cuts):
        paths = [c for p in paths for c in p.children()]
    got = collections.Counter()
    for p in paths:
        assert simhash.Path.of(p.code).fixed == p.fixed
        for a, b, d in simhash.pairs(fp, fp & np.uint64(p.fixed), p):
            for x, y, z in zip(a.tolist(), b.tolist(), d.tolist(), strict=True):
                got[min(x, y), max(x, y), z] += 1
    return got


def test_prints_are_the_majority_of_the_hashes(monkeypatch):
    texts = ["", None, " \t", "One", "one TWO", "one two three", "É a b c d", "a b " * 400, *(t for _, t in corpus(1, 20))]
    want = [brute_print(t) for t in texts]
    assert simhash.fingerprints(texts).tolist() == want
    monkeypatch.setattr(simhash, "HASHES", 37)
    assert simhash.fingerprints(texts).tolist() == want


def test_every_pair_once_at_any_fineness(monkeypatch):
    rng = random.Random(4)
    fp = ball(rng, 700, 4)
    x = fp[:, None] ^ fp[None, :]
    d = np.bitwise_count(x)
    want = {(i, j, int(d[i, j])) for i, j in zip(*np.nonzero(np.triu(d <= 3, 1)), strict=True)}
    for cuts in (0, 1, 2):
        got = found_pairs(fp, cuts)
        assert set(got) == {(int(i), int(j), k) for i, j, k in want} and set(got.values()) == {1}
    monkeypatch.setattr(simhash, "PAIRS", 50)
    assert set(found_pairs(fp, 0)) == {(int(i), int(j), k) for i, j, k in want}


def test_merge_gives_least_members():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, (2, 300))
    label = simhash.merge(np.arange(500), a, b)
    up = list(range(500))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((find(x), find(y)))
        up[y] = x
    assert label.tolist() == [find(k) for k in range(500)]


def got_rows(df):
    return collections.Counter(tuple(r) for r in df.collect() if r["doc_id"] is not None)


def test_matches_all_pairs(make_docs):
    rows = corpus(7)
    assert got_rows(simhash.near_duplicates(make_docs(rows).repartition(3))) == brute(rows)


def test_large_keys_are_cut_finer(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "KEY_ROWS", 20)
    rng = random.Random(8)
    base = [f"v{rng.randrange(2000)}" for _ in range(300)]
    family = [" ".join(f"z{rng.randrange(99)}" if rng.random() < 0.03 else w for w in base) for _ in range(40)]
    rows = corpus(8, 40) + list(enumerate(family, 1000))
    want = brute(rows)
    assert got_rows(simhash.near_duplicates(make_docs(rows))) == want
    pairs = simhash.links(make_docs(rows)).collect()
    prints = {p for _, p, _, _ in want}
    assert len(pairs) == len({frozenset((r["fp_a"], r["fp_b"])) for r in pairs})
    assert len(pairs) == sum((int(a, 16) ^ int(b, 16)).bit_count() <= 3 for a in prints for b in prints if a < b)


def test_odd_rows(make_docs, odd_rows):
    out = simhash.near_duplicates(make_docs(odd_rows, clash=True))
    assert got_rows(out) == brute(odd_rows)
    nobody = [r for r in out.collect() if r["doc_id"] is None]
    assert len(nobody) == sum(i is None for i, _ in odd_rows) and all(r["component_id"] is None for r in nobody)
    assert simhash.near_duplicates(make_docs([])).count() == 0
