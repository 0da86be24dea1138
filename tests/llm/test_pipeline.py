"""The stages of the corpus pipeline, one by one and together, against brute force."""

import collections
import random

import corpus_pipeline
import pytest
from test_pairs_and_lines import brute_components, brute_lines, corpus

from quiltspark.llm import toxicity


def columns_of(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.fixture
def folder(spark, tmp_path, make_docs):
    """A folder with documents and labels."""

    def make(rows, toxic):
        path = str(tmp_path / f"d{len(list(tmp_path.iterdir()))}")
        make_docs(rows).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return make


def some_texts(n=160):
    rng = random.Random(1)
    clean = [f"w{k}" for k in range(300)]
    bad = ["grubbish", "slomp", "vexling", "drattle"]
    rows, toxic = [], {}
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(8, 60))]
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
    return rows, toxic


def check_kept(kept, toxic):
    """No clean document goes; of the toxic ones three quarters do, which is about the
    recall that the README gives for small training sets."""
    assert all(i in kept for i, t in toxic.items() if not t)
    assert sum(i not in kept for i, t in toxic.items() if t) >= 0.75 * sum(toxic.values())


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, make_docs):
    rows, toxic = some_texts()
    rows += [(500, None), (501, ""), (None, "w1 w2 w3"), (502, "w4 " * 30_000)]
    path = folder(rows, toxic)
    docs = make_docs(rows, clash=True)
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = [(r["doc_id"], r["text"]) for r in toxicity.score(docs, model).collect() if r["predicted"] == 0]
    got = corpus_pipeline.drop_toxic(spark, docs, path)
    assert got.columns == docs.columns and columns_of(got.collect()) == collections.Counter(want)
    kept = {i for i, _ in want}
    check_kept(kept, toxic)
    assert {500, 501, None, 502} <= kept


def test_one_long_text_does_not_end_the_training(spark, folder, make_docs, monkeypatch):
    rows, toxic = some_texts()
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", sum(len(t) for _, t in rows) + 10)
    long = [(900 + k, "w5 " * 40_000) for k in range(4)]
    path = folder(rows + long, toxic | {i: 0 for i, _ in long})
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, make_docs(rows + long), path).collect()}
    check_kept(kept, toxic)


def test_lines_go_and_lengths_follow(spark, make_docs):
    p = "p1\np2\np3\np4"
    rows = [(1, f"a\n{p}\nb"), (2, f"c\n{p}\nd"), (3, None), (4, ""), (5, "one line"), (6, p)]
    docs = make_docs(rows, clash=True)
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    found = got.collect()
    assert got.columns == docs.columns
    assert columns_of(found) == collections.Counter((i, t) for (i, t, _, _), n in brute_lines(rows).items() for _ in range(n))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found)


def test_one_of_each_group_stays(spark, make_docs):
    rows = corpus(21) + [(9000, None), (9001, ""), (None, "no id"), (None, "no id")]
    part = brute_components(rows)
    docs = make_docs(rows, clash=True)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = collections.Counter((i, t) for i, t in rows if i is None or part[i] == i)
    assert got.columns == docs.columns and columns_of(got.collect()) == want


def test_unlike_texts_of_one_id_stay(spark, make_docs):
    base = " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (1, "quite another text of some seven words"), (2, base + " end"), (2, None), (2, ""), (3, base), (3, base), (None, base)]
    got = columns_of(corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), "").collect())
    assert got == collections.Counter([(1, base), (1, rows[1][1]), (2, None), (2, ""), (None, base)])


def check_packed(rows, ids):
    """Pieces of every document, in order and without a gap, in sequences of at most 4096."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_run_over_all_stages(spark, folder, odd_rows):
    rows, toxic = some_texts(80)
    extra = [(i + 2000 if i is not None else None, t) for i, t in odd_rows]
    path = folder(rows + extra, toxic)
    out = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, path)
        assert docs.columns == before, name
    check_packed(out, {r["doc_id"] for r in docs.select("doc_id").collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "best-fit packing"]


def test_run_over_nothing_and_over_toxic_texts_only(spark, folder):
    assert corpus_pipeline.run(spark, folder([], {})).count() == 0
    rows, _ = some_texts(30)
    some = corpus_pipeline.run(spark, folder(rows, {i: 1 for i, _ in rows}))
    assert some.count() >= 0 and "sequence_id" in some.columns
