"""Operators do the whole job: nothing is decided by where a text is cut."""

import pickle
import numpy as np
import pytest

from pyspark import cloudpickle
from pyspark.sql import functions as F

from quiltspark.llm import htmltext, syncmers, toxicity


def toxicity_model(seed=6):
    return toxicity.Model(np.random.default_rng(seed).normal(0, 3, toxicity.BUCKETS).tolist(), -0.25)


def word_value(model, word):
    of = toxicity.Weights(model.weight)
    found = toxicity.grams(word)
    return sum(of[g] for g in found) / len(found) if found else 0.0


def test_toxicity_takes_the_highest_of_all_windows():
    model, rng = toxicity_model(), np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 60, n)) for n in (1, 31, 32, 33, 64, 200, 1000)] + ["", None, " ... "]
    expected = []
    for t in texts:
        w = (t or "").split()
        starts = range(max(1, len(w) - toxicity.WORDS + 1))
        best = max(sum(word_value(model, x) for x in set(w[a : a + toxicity.WORDS])) for a in starts)
        expected.append(best / toxicity.WORDS + model.bias)
    got = toxicity.Scorer(model).logits(texts)
    assert got == pytest.approx(expected, abs=1e-6)
    assert got.tolist() == [toxicity.Scorer(model).logit(t) for t in texts]  # whatever texts are beside it


def test_toxicity_does_not_depend_on_the_word_offset():
    model = toxicity.Model([0.0] * toxicity.BUCKETS, -1.0)
    for g in toxicity.grams("vilegrub") + toxicity.grams("scumhead"):
        model.weight[toxicity.Buckets()[g]] = 20.0
    insult = "vilegrub scumhead"
    scores = [toxicity.Scorer(model).logit(" ".join(["..."] * k + [insult] + ["..."] * 80)) for k in range(70)]
    assert max(scores) == min(scores) > 0


def test_toxicity_reads_words_without_spaces_to_their_end():
    text = "".join(chr(0x4E00 + 7 * k % 5000) for k in range(700))
    pieces = toxicity.places(f"a {text} ({text[:64]}) {'-' * 100}")
    assert pieces[0] == "a" and pieces[-2:] == [text[:64], ""]
    whole = {text[i : i + 5] for i in range(len(text) - 4)}
    assert whole <= {g for p in pieces for g in toxicity.grams(p)}
    assert max(map(len, pieces)) <= toxicity.LONGEST
    model = toxicity.Model([0.0] * toxicity.BUCKETS, -1.0)
    for g in toxicity.grams("vilegrub"):
        model.weight[toxicity.Buckets()[g]] = 2000.0
    clean = toxicity.Scorer(model).logit(text)
    for at in (0, 30, 60, 62, 64, 66, 300, 692):
        for insult in ("vilegrub", ".vilegrub.", "_vilegrub\u200b"):
            assert toxicity.Scorer(model).logit(text[:at] + insult + text[at:]) > 0 > clean


def test_a_passage_has_its_anchors_in_any_text(spark):
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in rng.integers(0, 10**6, 60)]
    long = [f"w{k}" for k in rng.integers(0, 10**6, 20_000)]
    rows = [" ".join(passage), " ".join(long[:9_000] + passage + long[9_000:]), " ".join(long[:100] + ["other"] + long[101:])]
    df = spark.createDataFrame([(rows[0], rows[1], rows[2], " ".join(long))], "a string, b string, c string, d string")
    found = df.select(*[syncmers.anchors(F.col(x)).alias(x) for x in "abcd"])
    r = found.select("a", "b", syncmers.likeness(F.col("c"), F.col("d")).alias("near")).first()
    own, there = ({x["h"]: x["p"] for x in r[n]} for n in "ab")
    assert len(own) > 15 and all(there[h] == p + 9_000 for h, p in own.items())
    assert len(there) > 20_060 / 3
    assert 0.99 < r["near"] < 1  # one changed word of 20,000 is seen


def test_main_text_of_parts_with_misleading_names():
    text = "<h1>A title</h1><p>The first paragraph of this page is here.</p><p>Then, after it, the second paragraph.</p>"
    plain = "A title The first paragraph of this page is here. Then, after it, the second paragraph."
    menu = "<nav><a href=a>Home</a></nav><div class=menu><a href=b>News</a> <a href=c>Sport</a></div>"
    for name in ("content has-sidebar", "site no-sidebar", "post-notice", "post comments-open", "page header-fixed"):
        assert htmltext.main_text(f"<body>{menu}<div class='{name}'>{text}</div><footer>f</footer></body>") == plain
        assert htmltext.main_text(f"<main>{menu}<div id=no-share><div class='{name}'>{text}</div></div></main>") == plain
    for page in (text, f"<article>{text}</article>", f"<div class=content>{text}</div>"):
        assert htmltext.main_text(f"<body><form method=post><input>{menu}{page}<button>Go</button></form></body>") == plain
    # what they name stays out, also if it is long
    reader = "<div class=comments><p>" + "a reader wrote this. " * 12 + "</p></div>"
    assert htmltext.main_text(f"<div class=content>{text}</div>{reader}<form><p>Sign up here</p></form>") == plain
    assert htmltext.main_text(f"<div class='site no-sidebar'><div class=content>{text}</div>{reader}<div class=sidebar><p>aside text</p></div></div>") == plain
    assert htmltext.main_text("<div class=x style='display:none'><p>hidden text</p></div>") == ""


def test_one_scorer_a_worker_and_model():
    # pickled by reference, so that tasks of one worker share the module's words
    assert pickle.loads(cloudpickle.dumps(toxicity._scorer)) is toxicity._scorer
    model = toxicity_model()
    assert toxicity._scorer(1, model) is toxicity._scorer(1, model)
    assert toxicity._scorer(2, toxicity.Model(model.weight, 1.0)).bias == 1.0
