import collections
import hashlib
import itertools
import random
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quiltspark.llm import htmltext, nbest, packing, packplan, syncmers, tokenstore, wordcode

BYTES, WORDS, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def plain(path):
    """The tokenizer as it comes: strings of special tokens are those tokens."""
    return Tokenizer.from_file(path)


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "hi", "End.", "ΟΔΟΣ,", "\n", "x!", "é;", "e\u0301."]


@pytest.mark.parametrize("path,keeps", [(BYTES, True), (WORDS, False)])
def test_word_codes_are_the_tokenizers(path, keeps):
    t, code = plain(path), wordcode.WordEncoder(path, keeps)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t  aé'sT1.,!́<|>", max_size=40)), max_size=6))
    def same(texts):
        assert [np.frombuffer(b, code.kind).tolist() for b in code.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]

    same()


def test_perfect_hash_is_minimal_and_rejects():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    keys = np.unique(keys)
    index = tokenstore.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    shard = tokenstore.Shard(tokenstore.shard_row(0, 0, keys.tolist(), [b"\x01\x00"] * len(keys), 2))
    strange = np.setdiff1d(np.arange(20_000), keys)
    assert (shard.find(strange)[1] > 0).mean() < 1e-3
    assert tokenstore.PerfectHash.build(np.zeros(0, np.int64)).slots(np.array([5])).tolist() == [-1]


def test_store_round_trip(spark, make_docs, odd_rows, tmp_path):
    t = plain(BYTES)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for name, rows in (("odd", odd_rows), ("none", [])):
        path = str(tmp_path / name)
        tokenstore.write_corpus(make_docs(rows, clash=True), path, BYTES, 2, shard_ids=500)
        starts = {(r["part"], r["shard"]): r["shard_start"] for r in tokenstore.shard_starts(spark, path).collect()}
        got = [(r["doc_id"], starts[r["part"], r["shard"]] + r["start_in_shard"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokenstore.read_corpus(spark, path).collect()]
        at, expected = 0, []
        for i, text in sorted(rows, key=order):
            ids = t.encode(text or "", add_special_tokens=False).ids + [2]
            expected.append((i, at, ids))
            at += len(ids)
        assert sorted(got, key=lambda r: r[1]) == expected
    found = tokenstore.lookup(spark, str(tmp_path / "odd"), [13, 9, -5, 777]).collect()
    assert collections.Counter(r["doc_id"] for r in found) == {13: 2, 9: 2, -5: 1}
    assert tokenstore.lookup(spark, str(tmp_path / "odd"), []).count() == 0
    with pytest.raises(ValueError):
        tokenstore.lookup(spark, path, list(range(tokenstore.LOOKUP_KEYS + 1)))


def best_fit_decreasing(lengths, cap):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        insort(rooms, (rooms.pop(k) if k < len(rooms) else cap) - x)
    return len(rooms)


def check_plan(lengths, cap, **kw):
    hist = collections.Counter(lengths)
    ranks, load = collections.Counter(), collections.defaultdict(list)
    for length, rank, n, seq, each, offset in packplan.plan(hist, cap, **kw):
        for k in range(n):
            ranks[length, rank + k] += 1
            load[seq + k // each].append((offset + k % each * length, length))
    assert ranks == collections.Counter((x, k) for x, n in hist.items() for k in range(n))
    for held in load.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= cap
    return len(load)


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(5)
    cap = 512
    for lengths in (
        rng.integers(1, cap + 1, 3000), np.minimum(cap, rng.geometric(0.01, 2000)), rng.integers(170, 260, 700),
        [300] * 900 + [212] * 400, [cap] * 5, [1], [], rng.integers(60, 64, 50),
    ):
        lengths = [int(x) for x in lengths]
        used = check_plan(lengths, cap)
        assert used <= best_fit_decreasing(lengths, cap)
        assert used >= -(-sum(lengths) // cap)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_any_plan_is_whole(lengths):
    check_plan(lengths, 64, groups=(5,))


def test_placing_pieces(make_docs, odd_rows):
    t, cap = plain(WORDS), 64
    rows = odd_rows + [(100 + k, "same words in all of these") for k in range(400)]
    placed = packing.place(packing.pieces(make_docs(rows, clash=True), WORDS, 1, cap), cap).collect()
    expected = collections.Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), cap)):
            expected[i, k, a, tuple(ids[a : a + cap])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in placed) == expected
    at = collections.defaultdict(list)
    for r in placed:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in at.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[0][0] == 0 and sum(held[-1]) <= cap
    assert packing.place(packing.pieces(make_docs([]), WORDS, 1, cap), cap).count() == 0


def test_sequences_hold_their_pieces(make_docs):
    placed = packing.place(packing.pieces(make_docs([(k, "some words " * k) for k in range(30)]), WORDS, 1, 64), 64)
    rows = packing.sequences(placed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 64 for r in rows)
    with pytest.raises(ValueError):
        packing.place(placed, 64)


def all_ways(lattice, text):
    edges = lattice.edges(text)
    ways = {0: [(0.0, ())]}
    for j in range(1, len(text) + 1):
        ways[j] = [(s + w, ids + put) for i, w, put in edges[j] for s, ids in ways[i]]
    return sorted(ways[len(text)], key=lambda x: (-x[0], x[1]))


def check_n_best(lattice, text, n):
    expected = all_ways(lattice, text)
    ids, total, score, others = lattice.n_best(text, n)
    ids = np.frombuffer(ids, "<u4").tolist()
    found = [(score, tuple(ids))] + [(s, tuple(nbest.applied(ids, changes))) for s, _, changes in others]
    assert [round(s, 6) for s, _ in found] == [round(s, 6) for s, _ in expected[:n]]
    assert len(set(found)) == len(found) and {(round(s, 6), w) for s, w in found} <= {(round(s, 6), w) for s, w in expected}
    assert [m for _, m, _ in others] == [len(w) for _, w in found[1:]] and total == len(ids)


def test_n_best_of_the_model():
    c = nbest.codec(PIECES)
    for text in ("", "a", "hello", " thaner, the cat", "a  b", "wör梦龘x\n", "in on at", "🙂"):
        check_n_best(c.lattice, c.normalized(text), 4)


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab▁c", max_size=9), st.integers(1, 6))
def test_n_best_with_ties(text, n):
    pieces = {"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -2.0), "ba": (3, -1.5), "▁": (4, -1.0), "▁a": (5, -2.0), "aa": (6, -2.0), "▁ab": (7, -2.5), "▁▁": (8, -2.0)}
    check_n_best(nbest.Lattice(pieces, None, 99), text, n)


def test_parts_with_unknown_characters_are_worked_out_together(monkeypatch):
    lattice = nbest.codec(PIECES).lattice
    parts = [f"{a}龘{b}" for a in "abcdefgh" for b in "xyz梦"]
    expected = {p: lattice.best(p) for p in parts}
    monkeypatch.setattr(nbest.Lattice, "best", lambda *_: pytest.fail("one by one"))
    found = {}
    lattice._best_together(parts, 3, found)
    assert {p: (v[0], v[1]) for p, v in found.items()} == {p: (v[0], v[1]) for p, v in expected.items()}
    assert all(np.allclose(found[p][2:], expected[p][2:]) for p in parts)


@given(st.lists(st.lists(st.floats(-9, 0), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 5))
def test_mixes_left_out_are_not_among_the_best(ways, n):
    ways = [sorted(w, reverse=True) for w in ways]
    cost = lambda pick: -sum(w[i] for w, i in zip(ways, pick, strict=True))
    every = sorted(cost(p) for p in itertools.product(*(range(len(w)) for w in ways)))
    assert np.allclose(sorted(map(cost, nbest.picks(tuple(map(len, ways)), n)))[:n], every[:n])


def test_encoding_documents(make_docs, odd_rows):
    rows = nbest.encode(make_docs(odd_rows, clash=True), PIECES, 3).collect()
    assert len(rows) == len(odd_rows)
    texts = collections.Counter((i, t or "") for i, t in odd_rows)
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    for r in rows:
        scores = [r["score"]] + [o["score"] for o in r["others"]]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 3 and r["n_pieces"] == len(r["ids"]) // 4
    assert nbest.encode(make_docs([]), PIECES, 3).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return signed(seed)


def brute_anchors(text):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text.lower()) if x]
    h, n = [spark_hash([x.encode()]) for x in w], len(w)
    if n < syncmers.K:
        a = 0
        for x in h:
            a = spark_hash([a, x])
        return [(a % (1 << 64) >> 24, 0)] if n else []
    runs, out, last = [spark_hash(h[i : i + syncmers.S]) for i in range(n - syncmers.S + 1)], {}, syncmers.K - syncmers.S
    for i in range(n - syncmers.K + 1):
        inner = runs[i : i + last + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(spark_hash(inner) % (1 << 64) >> 24, i)
    return sorted(out.items())[: syncmers.KEEP]


def brute_likeness(a, b):
    a, b = dict(a), dict(b)
    both = sorted(a.keys() | b.keys())[: syncmers.KEEP]
    shared = [x for x in both if x in a and x in b]
    if not shared:
        return float(not both)
    moved = sorted(b[x] - a[x] for x in shared)
    reach = max(8, max([*a.values(), *b.values()]) / 4)
    return sum(abs(m - moved[(len(moved) - 1) // 2]) <= reach for m in moved) / len(both)


def test_fingerprints_match_brute_force(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 4)
    rng = random.Random(3)
    more = [(k, " ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) + rng.choice(["", "x", "."]) for _ in range(rng.randrange(1, 400)))) for k in range(20, 60)]
    for rows in (odd_rows + more, more[:1], []):
        got = syncmers.fingerprints(make_docs(rows, clash=True)).collect()
        ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        as_text = lambda a: " ".join(f"{h:x}.{p}" for p, h in sorted((p, h) for h, p in a))
        expected = []
        for k, (i, t) in enumerate(ordered):
            following = ordered[(k + 1) % len(ordered)][1]
            edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
            a, b, c = brute_anchors(t), brute_anchors(edited), brute_anchors(following)
            expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), brute_likeness(a, b), brute_likeness(a, c)))
        assert collections.Counter(tuple(r) for r in got) == collections.Counter(expected)


def test_fingerprints_use_no_python(make_docs):
    plan = syncmers.fingerprints(make_docs([(1, "a b c"), (2, "d")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = [
    ("<html><body><nav><a href=x>Home</a> <a>News</a></nav><article><h1>A &amp; B</h1><p>First  para\n graph.<p>Second <b>bo</b>ld.</article><footer>f</footer>", "A & B First para graph. Second bold."),
    ("<body><div id=menu><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=content><p>Long text of the page, first.</p><p>And more of it here, second.</p></div><div class='comments'><p>a reader says something very long about it all</p></div>", "Long text of the page, first. And more of it here, second."),
    ("<article><p>Text.</p><form><input><button>Go</button></form><div class='newsletter-signup'>Subscribe now</div><aside>side</aside><script>x='<p>no</p>'</script><style>p{}</style><!-- c --><p>More text.</p><section id=comments>bad</section></article>", "Text. More text."),
    ("<div class='page sidebar-left'><article><h1>T</h1><p>Kept although the wrapper names a sidebar.</p></article></div>", "T Kept although the wrapper names a sidebar."),
    ("", ""), (None, ""), ("<nav><a>only menu</a></nav>", ""), ("just text &lt;b&gt; &#233; &nbsp; x", "just text <b> é x"), ("<p", "<p"), ("</p></div>loose <b>end", "loose end"),
    ("<p>a<p>b<div>c" * 2000, " ".join(["a b c"] * 2000)),
]


def test_main_text():
    for html, expected in PAGES:
        assert htmltext.main_text(html) == expected


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(i if i else None, None if i == 1 else "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = htmltext.extract(df.withColumn("n_chars", F.lit("x"))).collect()
    assert collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in got) == collections.Counter((i if i else None, t, "x") for i, (_, t) in enumerate(PAGES))
    assert htmltext.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        htmltext.extract(df.withColumn("text", F.lit("")))


def test_pages_of_the_tables_are_their_articles(spark):
    """The tables' pages say which part is theirs: all of the article element."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<(?:/?(?:p|h1|br|div|li|ul)\b)[^>]*>", " ", inner)
        assert htmltext.main_text(r["html"]).split() == htmltext.unescape(re.sub(r"<[^>]+>", "", inner)).split(), r["page_id"]


def test_crc_of_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(struct.pack("<2I", 1, 2))
