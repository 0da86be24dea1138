import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from paths import SF0001
from quiltspark.llm import crosstoken, ranked

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def brute_groups(a, b):
    common = sorted(set(a) & set(b))
    return [sum(x <= c for x in a) for c in common], [sum(x <= c for x in b) for c in common]


def test_align_is_the_common_ends():
    rng = random.Random(0)
    for _ in range(300):
        n = rng.randrange(1, 80)
        p, q = rng.choice([(0.1, 0.1), (0.5, 0.5), (0.95, 0.9), (1, 1), (0.9, 0.2)])
        a, b = ([k for k in range(1, n) if rng.random() < x] + [n] for x in (p, q))
        assert crosstoken.align(a, b) == brute_groups(a, b)
    assert crosstoken.align([], []) == ([], [])
    with pytest.raises(ValueError):
        crosstoken.align([1, 2], [1, 3])


def plain_rows(rows):
    """The contract, word for word, over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(PATHS[0])
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = crosstoken.byte_values()
    per_doc, counts = [], collections.Counter()
    for i, text in rows:
        links, groups, a, b = [], "", [], []
        if text:
            raw = f" {text}".encode()
            a, b = ta.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
            xa = [bytes(letters[c] for c in ta.id_to_token(k)) for k in a]
            xb = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
            if b"".join(xa) != raw or b"".join(xb) != raw:
                a, b = [], []
        if a:
            ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
            sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
            j = 0
            for k in range(len(a)):
                while eb[j] <= sa[k]:
                    j += 1
                m = j
                while m < len(b) and sb[m] < ea[k]:
                    links.append((a[k], b[m]))
                    m += 1
            both = sorted(set(ea) & set(eb))
            ca, cb = np.searchsorted(ea, both, side="right").tolist(), np.searchsorted(eb, both, side="right").tolist()
            groups = ";".join(",".join(map(str, a[x:y])) + "|" + ",".join(map(str, b[u:v])) for x, y, u, v in zip([0, *ca], ca, [0, *cb], cb, strict=False))
        counts.update(set(links))
        per_doc.append((i, len(a), len(b), groups.count("|"), links, groups))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return collections.Counter(
        (i, na, nb, ng, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, na, nb, ng, links, g in per_doc
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD = [
    "<s> </s> <unk> <0x41> <|endoftext|>", "▁ mark", "a▁b", "tab\tand\nline\r\n", " leading", "trailing ", "two  spaces", "nbsp x   y",
    "　wide", "é é ﬁ ｆ", "🙂🙂 漢字かな", "\x00\x01", "it's we'll 'tis", "12345678901234567890", " ", "\n", "don 't x", "​‍", "x" * 3000,
]


def test_alignment_matches_the_contract(make_docs, odd_rows, monkeypatch):
    given = pq.read_table(f"{SF0001}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in given] + odd_rows + list(enumerate(HARD, 5000))
    want = plain_rows(rows)
    df = make_docs(rows, clash=True).repartition(3)
    got = crosstoken.alignments(df, *PATHS).select(*COLUMNS).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    monkeypatch.setattr(crosstoken, "SLICE", 3000)  # several slices of pairs
    got = crosstoken.alignments(df, *PATHS).select(*COLUMNS).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert crosstoken.alignments(make_docs([]), *PATHS).count() == 0


def test_words_are_forgotten_beyond_the_limit(monkeypatch):
    monkeypatch.setattr(crosstoken, "CACHE_WORDS", 50)
    code = crosstoken.Coder(*PATHS)
    texts = [" ".join(f"w{k + j}" for j in range(30)) for k in range(0, 300, 10)]
    for t in texts:
        counts, links, groups = next(iter(code.some([t])))
        want = code.whole(t)
        assert (counts == want[0]).all() and sorted(links.tolist()) == sorted(want[1].tolist()) and groups == want[2]


def brute_ranks(docs, items, k):
    low = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_texts, n_terms = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_texts // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return collections.Counter(out)


def some_words(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "É", "naïve", "x1", f"w{rng.randrange(60)}", f"w{rng.randrange(60)}"]) for _ in range(n))


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_ranks_match_every_document(make_docs, make_items, odd_rows, monkeypatch):
    rng = random.Random(2)
    docs = [(i, some_words(rng, rng.randrange(1, 60))) for i in range(300)] + odd_rows
    items = [(i, some_words(rng, rng.randrange(1, 12))) for i in range(40)]
    items += [(3, "w1, more of_item 3"), (None, "w2 no id"), (50, None), (51, "!?"), (52, "nowhere-else"), (53, items[0][1]), (54, "one two three")]
    df, asked = make_docs(docs, clash=True), make_items(items)
    want = brute_ranks(docs, items, 7)
    assert collections.Counter(tuple(r) for r in ranked.search(df, asked, 7).collect()) == want
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 10)
    monkeypatch.setattr(ranked, "TOGETHER", 16)
    assert collections.Counter(tuple(r) for r in ranked.search(df, asked, 7).collect()) == want
    assert ranked.search(make_docs([]), asked, 7).count() == ranked.search(df, make_items([]), 7).count() == 0


def test_plan_adds_every_term_once_and_shares():
    rng = random.Random(5)
    items = [{rng.randrange(30) for _ in range(rng.randrange(1, 15))} for _ in range(60)] + [set(), {99}]
    plan = ranked.Plan(items)
    value = np.array([rng.randrange(1, 10**9) for _ in range(100)])
    terms = sorted(plan.set_of)
    got = plan.scores(np.array([plan.set_of[t] for t in terms]), np.zeros(len(terms), int), value[terms], 1)[:, 0]
    assert got.tolist() == [int(sum(value[t] for t in s)) for s in items]
    assert plan.unions and plan.additions() < sum(max(0, len(s) - 1) for s in items)
