import collections
import random

import numpy as np

from quiltspark.llm import components, jaccardjoin, linededup, rtree, shingles


def words(t):
    return (t or "").encode().lower().split()


def word_set(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """{id: component} by all pairs; rows of one id are one node."""
    sets = [(i, word_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in up}


def family(rng, base, n, share):
    """Texts made from ``base`` by changing a share of its words."""
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.sample(range(len(w)), max(1, int(share * len(w)))):
            w[k] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for size, n, share in ((60, 40, 0.02), (200, 25, 0.03), (30, 5, 0.03), (9, 6, 0.1), (400, 3, 0.01)):
        base = some(size)
        texts += [" ".join(base)] + family(rng, base, n, share)
    passage = some(70)
    texts += [" ".join(some(rng.randrange(20, 80)) + passage + some(rng.randrange(20, 80))) for _ in range(40)]
    texts += [" ".join(some(rng.randrange(1, 300))) for _ in range(60)] + texts[:6]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_shingle_sets_are_the_words_sets():
    texts = ["A b\x0bC d e f", "a b c d e f", "", None, "x", "a b c", "x " * 700, "É é", "b a"] + ["q " * 3 + "w" * 2_000_000]
    sets = shingles.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(word_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(word_set(a) & word_set(b)), (i, j)
    assert all((s == shingles.shingle_set(t)).all() for s, t in zip(sets, texts, strict=True))


def test_tree_links_give_the_components():
    for seed in range(3):
        rows = corpus(seed)
        sets = shingles.shingle_sets([t for _, t in rows])
        expected = brute_components(rows)
        label = {i: i for i, _ in rows}
        for a, b in rtree.links(sets):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        assert label == expected


def test_node_bound_never_hides_a_link():
    rng = np.random.default_rng(0)
    sizes = rng.integers(20, 200, 300)
    points = np.stack([rng.multinomial(s, np.ones(16) / 16) for s in sizes])
    tree = rtree.RTree(points, sizes)
    for k in range(0, 300, 17):
        found = set(tree.near(points[k], int(sizes[k])).tolist())
        bound = np.minimum(points, points[k]).sum(1)
        assert set(np.flatnonzero(rtree.linked(sizes, sizes[k], bound)).tolist()) <= found


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 1000 for k in range(1000, 1100)}}


def check_join(df, rows):
    got = jaccardjoin.near_duplicates(df).collect()
    expected = brute_components(rows)
    sizes = collections.Counter((i, len(word_set(t))) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected


def test_join_matches_all_pairs(make_docs):
    rows = corpus(11)
    check_join(make_docs(rows).repartition(3), rows)


def test_join_in_tiles_and_many_parts(make_docs, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "GROUP_SHINGLES", 1500)
    monkeypatch.setattr(jaccardjoin, "LIST_ROWS", 900)
    monkeypatch.setattr(jaccardjoin, "HEAVY", 30)
    rows = corpus(12)
    check_join(make_docs(rows), rows)


def test_join_of_odd_rows(make_docs, odd_rows):
    check_join(make_docs(odd_rows, clash=True), odd_rows)
    assert jaccardjoin.near_duplicates(make_docs([])).count() == 0
    assert jaccardjoin.near_duplicates(make_docs([(1, None)])).collect()[0].asDict() == {"doc_id": 1, "n_shingles": 0, "component_id": 1}


def common_phrases(seed, n_plain=150):
    """Unlike texts that share a phrase or two with many others, and some near copies of them."""
    rng = random.Random(seed)
    some = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    phrases = [some(14) for _ in range(5)]
    texts = []
    for k in range(n_plain):
        texts.append(" ".join(some(rng.randrange(20, 500)) + phrases[k % 5] + some(rng.randrange(20, 300)) + phrases[rng.randrange(5)]))
    for t in texts[:60]:
        w = t.split()
        cut = int(len(w) * rng.choice((0.02, 0.08, 0.13, 0.2, 0.24)))
        texts.append(" ".join(w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]))
    for base in texts[60:64]:
        texts += family(rng, base.split(), 20, 0.01)
    return list(enumerate(texts))


def test_common_phrases_do_not_move_unlike_texts(make_docs, monkeypatch):
    rng = random.Random(5)
    some = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    phrase, seen, staged = some(24), {}, jaccardjoin.staged
    texts = [" ".join(some(200) + phrase + some(176)) for _ in range(28)]
    rows = list(enumerate([*texts, texts[3].rsplit(" ", 30)[0]]))
    monkeypatch.setattr(jaccardjoin, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
    check_join(make_docs(rows).repartitionByRange(29, "doc_id"), rows)  # no task sees the phrase twice
    assert seen["met"].filter("need is null").select("b").distinct().count() == 29  # all in long lists
    assert sorted(r["rep"] for r in seen["members"].select("rep").distinct().collect()) == [3, 28]


def test_join_with_few_and_many_long_lists(make_docs):
    for seed, parts in ((6, 30), (7, 60)):
        rows = common_phrases(seed, 90)
        check_join(make_docs(rows).repartition(parts, "doc_id"), rows)


def brute_lines(rows):
    keyed = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, cover = set(), collections.defaultdict(set)
    for i, t in keyed:
        x = t.split("\n")
        for k in range(len(x) - 2):
            w = tuple(x[k : k + 3])
            if not "".join(w).strip(" \t\r\x0b\x0c"):
                continue
            if w in seen:
                cover[i, t] |= {k, k + 1, k + 2}
            seen.add(w)
    cut = lambda i, t: t if t is None else "\n".join(v for k, v in enumerate(t.split("\n")) if k not in cover[i, t])
    return collections.Counter((i, cut(i, t), 0 if t is None else len(t.split("\n")), len(cover[i, t])) for i, t in rows)


def test_repeated_lines_go(make_docs, odd_rows):
    p = "p1\np2\np3\np4"
    rows = [(1, f"a\n{p}\nb"), (2, f"c\n{p}\n{p}\nd"), (3, "p1\np2\nx"), (4, "r\nr\nr\nr\nr"), (5, "\n\n\n\n"), (6, "\n \n\t\n"), (7, f"{p}\r"), (8, p)]
    for some in (rows, [r for r in odd_rows if r[0] not in (9, 13)], []):
        got = linededup.remove_repeated_lines(make_docs(some, clash=False)).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert collections.Counter(tuple(r) for r in got) == brute_lines(some)


def test_lines_keep_other_columns_and_equal_rows(make_docs):
    out = linededup.remove_repeated_lines(make_docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")], clash=True)).collect()
    assert sorted((r["doc_id"], r["text"], r["rep"]) for r in out) == [(1, "a\nb\nc", "rep"), (1, "a\nb\nc", "rep"), (2, "", "rep")]
