"""Operator 1: a hierarchical Pitman-Yor language model, learned and applied as Spark jobs.

Tokens are a text's words (A-Z lower-cased) and one end.  Every token is drawn
from the restaurant of its context, the token before it (the end before a text's
first); all context restaurants share one parent, the restaurant of all words,
whose own base is uniform over the training vocabulary and one more word.  A
table of a context restaurant is a customer of the parent.  Words are 64-bit
hashes, contexts the upper 48 bits of them.

Seating is sampled by Gibbs.  A word's customers in all contexts, and in the
parent, are in one shard (by the word's hash).  What a context restaurant holds
in all is spread over shards: each shard tells the context's owner (the shard of
its hash) its share, and gets back the sums of the contexts that it has; they are
those of the round before.  In a round, words of up to ``EACH`` customers in a
restaurant are taken up and seated again one customer at a time; the customers
of others are all taken up and seated again in order, from the ``EACH``-th on in
chunks of a tenth with a binomial count of new tables.  The first round only
settles the totals; the predictive probabilities of the others are averaged.

Work and data: a task turns its texts into blocks of about ``BLOCK_TOKENS``
tokens.  A block sends each shard its distinct (word, context) pairs with
counts.  Shards count and sample.  For scoring the texts are read again, and a
block sends, sorted by pair, the documents that have them; a document's score is
the sum of what the shards return for its block.  A word that makes up a third of
all tokens costs a shard one row of pairs a block; for scoring, the blocks of a
shard are dealt to as many tasks as their size asks for, each with a copy of the
shard's state.  No list of contexts or words is whole in one task.

Null and empty texts are the end alone.  Null ids are kept (their crc32 is that
of the empty text, so they are training rows).  Repeated rows count each.  With
no training rows every probability is 1.  An empty table gives an empty result.
Only the two named columns are read, twice, so both readings have to give the
same rows (in any order).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import hashed_words

EACH, ROUNDS = 8, 3
BLOCK_TOKENS, SHARD_TOKENS, SCORE_BYTES = 2_000_000, 2_000_000, 64 << 20
STRENGTH = 1.0
END = np.uint64(0xE17A1465C6EF3700)  # like a word's
_CONTEXT = np.uint64(0xFFFFFFFFFFFF0000)


def token_ids(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The 64-bit ids of each text's tokens."""
    for words, _, counts in hashed_words(texts):
        at = 0
        for n in counts.tolist():
            yield np.append(words[at : at + n], END)
            at += n


def _squeezed(x: np.ndarray, rising: bool = False) -> bytes:
    """Integers from 0 on byte by byte of equal weight, compressed; ``rising`` ones by their steps."""
    x = x.astype("<u8")
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    size = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :size].T)
    return bytes([size]) + len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if size else b"")


def _ints(data: bytes, rising: bool = False) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if size:
        out[:, :size] = np.frombuffer(pa.decompress(data[9:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64) if rising else out.view("<i8").ravel()


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of hashes, so sorted ones are sorted by shard."""
    return (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


def _pair_order(word: np.ndarray, context: np.ndarray, n: int) -> np.ndarray:
    """The stable order by word and context, both numbers below ``n``."""
    key, bits = word * n + context, len(word).bit_length()
    if (n * n).bit_length() + bits < 64:  # one plain sort, the places in the lower bits
        return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


def _schema(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


COUNTS = "shard int, n_posts long, words binary, per_word binary, known binary, contexts binary, trained binary"
POSTS = (
    "shard int, block long, words binary, per_word binary, known binary, contexts binary, posted binary, posts binary, "
    "doc_ids array<bigint>, lengths array<bigint>, held array<boolean>"
)


def _blocks(shards: int, scoring: bool):
    """The pairs of blocks with their training counts, or with their documents."""
    schema = _schema(POSTS if scoring else COUNTS)

    def block_rows(block: int, ids: list[np.ndarray], doc_ids: list, held: list[bool]) -> pa.RecordBatch:
        lengths = [len(x) for x in ids]
        token = np.concatenate(ids)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), lengths)
        words, token = np.unique(token, return_inverse=True)  # from here on numbers
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = np.searchsorted(words, END)
        order = _pair_order(token, before, len(words))  # a pair's documents ascend
        token, context, doc = token[order], (words & _CONTEXT)[before[order]], doc[order]
        fresh_word = np.concatenate(([True], token[1:] != token[:-1]))
        fresh_pair = fresh_word | np.concatenate(([True], context[1:] != context[:-1]))
        pair_at, word_at = np.flatnonzero(fresh_pair), np.flatnonzero(fresh_word)
        first_pair = np.searchsorted(pair_at, word_at)
        per_word = np.diff(np.append(first_pair, len(pair_at)))
        if scoring:
            posted = np.diff(np.append(pair_at, len(token)))
        else:
            trained = np.add.reduceat((~np.array(held, bool))[doc].astype(np.int64), pair_at)
        cut = np.searchsorted(_shard(words, shards), np.arange(shards + 1, dtype=np.uint64))
        rows = []
        for p in range(shards):
            a, b = int(cut[p]), int(cut[p + 1])
            if a == b:
                continue
            pa_, pb = int(first_pair[a]), int(first_pair[b]) if b < len(words) else len(pair_at)
            ta, tb = int(pair_at[pa_]), int(pair_at[pb]) if pb < len(pair_at) else len(token)
            known, at = np.unique(context[pair_at[pa_:pb]], return_inverse=True)
            row = {"shard": p, "words": _squeezed(words[a:b], True), "per_word": _squeezed(per_word[a:b]), "known": _squeezed(known, True), "contexts": _squeezed(at)}
            if scoring:
                row |= {"block": block, "posted": _squeezed(posted[pa_:pb]), "posts": _squeezed(doc[ta:tb])}
            else:
                row |= {"n_posts": tb - ta, "trained": _squeezed(trained[pa_:pb])}
            rows.append(row)
        if scoring:  # the list of the block's documents goes along to one of its shards
            rows.append({"shard": rows[0]["shard"], "block": block, "doc_ids": doc_ids, "lengths": lengths, "held": held})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, doc_ids, held, size = [], [], [], 0
        for batch in batches:
            tokens = (x for at in range(0, batch.num_rows, 256) for x in token_ids(batch.column("text").slice(at, 256).to_pylist()))
            for key, out, own in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), tokens, strict=True):
                ids.append(own)
                doc_ids.append(key)
                held.append(out)
                size += len(own)
                if size >= BLOCK_TOKENS:
                    yield block_rows(block, ids, doc_ids, held)
                    block, ids, doc_ids, held, size = block + 1, [], [], [], 0
        if ids:
            yield block_rows(block, ids, doc_ids, held)

    return run


#: A shard's own row has no owner: its pairs, their tables (``seats``) and, of its words in the
#: parent, customers and tables.  The others tell an owner the shard's share in its contexts' customers and tables.
STATE = (
    "shard int, owner int, words binary, per_word binary, known binary, contexts binary, counts binary, seats binary, customers binary, tables binary, "
    "n_posts long, total long, n_seats long, n_words long, once long, twice long"
)
FOUND = "shard int, owner int, seats binary, customers binary, tables binary"


def _shares(shard: int, shards: int, known: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> list[dict]:
    cut = np.searchsorted(_shard(known, shards), np.arange(shards + 1, dtype=np.uint64)).tolist()
    return [
        {"shard": shard, "owner": o, "known": _squeezed(known[a:b], True), "customers": _squeezed(customers[a:b]), "tables": _squeezed(tables[a:b])}
        for o, (a, b) in enumerate(zip(cut, cut[1:], strict=False))
        if a < b
    ]


def _counted(shards: int):
    """The training counts of one shard's pairs (all pairs asked for, also at 0); every
    pair has one table, and every word one in the parent."""

    def run(table: pa.Table) -> pa.Table:
        joined = {c: [_ints(x, c in ("words", "known")) for x in table.column(c).to_pylist()] for c in ("words", "per_word", "known", "contexts", "trained")}
        words, word = np.unique(np.concatenate(joined["words"]), return_inverse=True)
        known, of = np.unique(np.concatenate(joined["known"]), return_inverse=True)
        first = np.cumsum([0, *map(len, joined["known"])])
        at = of[np.concatenate([x + a for x, a in zip(joined["contexts"], first, strict=False)])]
        key = np.repeat(word, np.concatenate(joined["per_word"])) * len(known) + at
        order = np.argsort(key)
        key, count = key[order], np.concatenate(joined["trained"])[order]
        fresh = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        word, at = np.divmod(key[fresh], len(known))
        count, per = np.add.reduceat(count, fresh), np.bincount(word)
        starts = np.concatenate(([0], np.cumsum(per)[:-1]))
        of_word, seats = np.add.reduceat(count, starts), np.minimum(count, 1)
        shard = table.column("shard")[0].as_py()
        row = {
            "shard": shard, "words": _squeezed(words, True), "per_word": _squeezed(per), "known": _squeezed(known, True),
            "contexts": _squeezed(at), "counts": _squeezed(count),
            "customers": _squeezed(np.add.reduceat(seats, starts)), "tables": _squeezed(np.minimum(of_word, 1)),
            "n_posts": sum(table.column("n_posts").to_pylist()), "total": int(count.sum()), "n_seats": int(seats.sum()),
            "n_words": int((of_word > 0).sum()), "once": int((count == 1).sum()), "twice": int((count == 2).sum()),
        }
        shares = _shares(shard, shards, known, np.bincount(at, count, len(known)), np.bincount(at, seats, len(known)))
        return pa.Table.from_pylist([row, *shares], _schema(STATE))

    return run


def _met(table: pa.Table) -> pa.Table:
    """What an owner's contexts hold in all shards, for each shard that has them."""
    known = [_ints(x, True) for x in table.column("known").to_pylist()]
    _, at = np.unique(np.concatenate(known), return_inverse=True)
    ends = np.cumsum([len(x) for x in known]).tolist()
    out = {"shard": table.column("shard"), "owner": table.column("owner"), "seats": pa.nulls(len(known), pa.binary())}
    for name in ("customers", "tables"):
        share = np.concatenate([_ints(x) for x in table.column(name).to_pylist()])
        sums = np.rint(np.bincount(at, share)).astype(np.int64)[at]
        out[name] = pa.array([_squeezed(sums[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())
    return pa.table(out).cast(_schema(FOUND))


def _found(state: DataFrame) -> DataFrame:
    """For each shard its own row and the sums of its contexts, a row an owner."""
    met = state.filter("owner is not null").select("shard", "owner", "known", "customers", "tables").groupBy("owner").applyInArrow(_met, FOUND)
    return met.union(state.filter("owner is null").select("shard", "owner", "seats", "customers", "tables"))


def _sums(found: list[dict]) -> tuple[np.ndarray, np.ndarray, dict]:
    """Customers and tables of a shard's contexts, and its own row."""
    of = sorted((r for r in found if r["owner"] is not None), key=lambda r: r["owner"])
    own = next(r for r in found if r["owner"] is None)
    return *(np.concatenate([_ints(r[c]) for r in of]) for c in ("customers", "tables")), own


def seated(n: np.ndarray, worth: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of n customers each, who all eat one dish; ``worth`` is what a new table
    weighs against an old one's customers less the discount."""
    t = np.minimum(n, 1).astype(np.int64)
    for size in range(2, EACH + 1):
        at = np.flatnonzero(n == size)
        if len(at):
            t[at] = _gibbs(size, worth[at], discount, rng)
    at = np.flatnonzero(n > EACH)
    if len(at):
        t[at] = _in_order(n[at], worth[at], discount, rng)
    return t


def _gibbs(size: int, worth: np.ndarray, discount: float, rng: np.random.Generator, sweeps: int = 2) -> np.ndarray:
    """Seat ``size`` customers of many dishes in order, then ``sweeps`` times take up each
    and seat it again."""
    m, rows = len(worth), np.arange(len(worth))
    seat, held = np.zeros((m, size), np.int8), np.zeros((m, size))
    held[:, 0] = 1
    moves = [(j, False) for j in range(1, size)] + [(j, True) for _ in range(sweeps) for j in range(size)]
    for j, again in moves:
        if again:
            held[rows, seat[:, j]] -= 1
        weight = np.where(held > 0, held - discount, 0)
        weight[rows, np.argmin(held, axis=1)] = worth  # an empty table: there is one while a customer is up
        total = np.cumsum(weight, axis=1)
        pick = (rng.random(m)[:, None] * total[:, -1:] >= total).sum(1).clip(0, size - 1)
        seat[:, j] = pick
        held[rows, pick] += 1
    return (held > 0).sum(1)


def _in_order(n: np.ndarray, worth: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    order = np.argsort(-n, kind="stable")
    n, worth = n[order], worth[order]
    t, at = np.ones(len(n)), 1
    while True:
        live = int(np.searchsorted(-n, -at, "left"))  # those with more than ``at`` customers
        if not live:
            break
        step = np.minimum(1 if at < EACH else max(1, at // 10), n[:live] - at)
        middle = at + (step - 1) / 2
        chance = worth[:live] / (worth[:live] + np.maximum(middle - discount * t[:live], 1 - discount))
        t[:live] += rng.binomial(step, chance)
        at += 1 if at < EACH else max(1, at // 10)
    out = np.empty(len(n), np.int64)
    out[order] = t
    return out


def _sampled(shards: int, discount: float, root_discount: float, root_total: float, root_tables: float, vocabulary: int, seed: int):
    """One Gibbs round over a shard's state, given the totals of the round before."""

    def run(fixed: pa.Table, found: pa.Table) -> pa.Table:
        row = fixed.to_pylist()[0]
        _, tables, own = _sums(found.to_pylist())
        known = _ints(row["known"], True)
        per, context, count = (_ints(row[c]) for c in ("per_word", "contexts", "counts"))
        starts = np.concatenate(([0], np.cumsum(per)[:-1]))
        rng = np.random.default_rng([seed, row["shard"]])
        customers, r = _ints(own["customers"]), _ints(own["tables"])
        base = (STRENGTH + root_discount * root_tables) / (vocabulary + 1)
        parent = (customers - root_discount * r + base) / (STRENGTH + root_total)
        worth = (STRENGTH + discount * tables[context]) * np.repeat(parent, per)
        t = seated(count, worth, discount, rng)
        customers = np.add.reduceat(t, starts)
        r = seated(customers, np.full(len(per), base), root_discount, rng)
        out = {
            "shard": row["shard"], "seats": _squeezed(t), "customers": _squeezed(customers), "tables": _squeezed(r),
            "n_seats": int(t.sum()), "n_words": int(r.sum()), "once": int((customers == 1).sum()), "twice": int((customers == 2).sum()),
        }
        shares = _shares(row["shard"], shards, known, np.bincount(context, count, len(known)), np.bincount(context, t, len(known)))
        return pa.Table.from_pylist([out, *shares], _schema(STATE))

    return run


PARTS = "block long, docs binary, scores binary, bases binary, knowns binary, doc_ids array<bigint>, lengths array<bigint>, held array<boolean>"


def _scored(samples: list[dict], vocabulary: int, total: int):
    """What one shard adds to the documents of some blocks."""

    def probabilities(rows: list[dict]) -> tuple[np.ndarray, ...]:
        state = next(r for r in rows if not r["round"])
        words, known = (_ints(state[c], True) for c in ("words", "known"))
        per, context, count = (_ints(state[c]) for c in ("per_word", "contexts", "counts"))
        starts = np.concatenate(([0], np.cumsum(per)[:-1]))
        p = np.zeros(len(count))
        for s in samples:
            eaten, tables, own = _sums([r for r in rows if r["round"] == s["round"]])
            t, r = _ints(own["seats"]), _ints(own["tables"])
            customers = np.add.reduceat(t, starts)
            base = (STRENGTH + s["root_discount"] * s["root_tables"]) / (vocabulary + 1)
            parent = np.repeat((customers - s["root_discount"] * r + base) / (STRENGTH + s["root_total"]), per)
            spread = (STRENGTH + s["discount"] * tables[context]) * parent
            p += (count - s["discount"] * t + spread) / (STRENGTH + eaten[context])
        of_word = np.add.reduceat(count, starts)
        pair_key = np.repeat(np.arange(len(words)), per) * len(known) + context
        return words, known, pair_key, np.log10(p / len(samples)), of_word

    def run(asked: pa.Table, states: pa.Table) -> pa.Table:
        if not asked.num_rows:  # a copy of the state that no block was dealt to
            return _schema(PARTS).empty_table()
        words, known, pair_key, logp, of_word = probabilities(states.to_pylist())
        out = []
        for row in asked.to_pylist():
            if row["words"] is None:
                out.append({c: row[c] for c in ("block", "doc_ids", "lengths", "held")})
                continue
            at = np.repeat(np.searchsorted(words, _ints(row["words"], True)), _ints(row["per_word"]))
            pair = np.searchsorted(pair_key, at * len(known) + np.searchsorted(known, _ints(row["known"], True))[_ints(row["contexts"])])
            doc, own = _ints(row["posts"]).astype(np.uint32), np.repeat(np.arange(len(pair)), _ints(row["posted"]))
            base = np.log10((of_word[at] + 1) / (total + vocabulary + 1))
            docs, where = np.unique(doc, return_inverse=True)
            sums = [np.bincount(where, x[own], len(docs)) for x in (logp[pair], base, (of_word[at] > 0).astype(float))]
            out.append({"block": row["block"], "docs": _squeezed(docs, True), **{c: x.tobytes() for c, x in zip(("scores", "bases", "knowns"), sums, strict=True)}})
        return pa.Table.from_pylist(out, _schema(PARTS))

    return run


def _summed(parts: pa.Table) -> pa.Table:
    """The documents of one block."""
    rows = sorted(parts.to_pylist(), key=lambda r: r["docs"] or b"")  # one order of the sums
    row = next(r for r in rows if r["doc_ids"] is not None)
    n = len(row["doc_ids"])
    sums = np.zeros((3, n))
    for part in rows:
        if part["docs"] is not None:
            where = _ints(part["docs"], True).astype(np.int64)
            for k, c in enumerate(("scores", "bases", "knowns")):
                sums[k, where] += np.frombuffer(part[c], float)
    columns = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["lengths"], pa.int64()),
        pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[0]),
    ]
    return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _totals(state: DataFrame) -> dict[str, int]:
    row = state.filter("owner is null").agg(*[F.sum(c).alias(c) for c in ("total", "n_seats", "n_words", "once", "twice")]).first()
    return {c: v or 0 for c, v in row.asDict().items()}


def _discount(once: int, twice: int) -> float:
    """From how many were seen once and twice."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def scores(docs: DataFrame, held_out: Column, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of
    ``docs``; learns from the rows where ``held_out`` is false."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, math.ceil(characters / 6 / SHARD_TOKENS))
    state = staged(texts.mapInArrow(_blocks(shards, False), COUNTS).groupBy("shard").applyInArrow(_counted(shards), STATE), "state")
    own = state.filter("owner is null")
    fixed = own.select("shard", "words", "per_word", "known", "contexts", "counts")
    sums = _totals(state)
    total, vocabulary, root_total, root_tables = sums["total"], sums["n_words"], float(sums["n_seats"]), float(sums["n_words"])
    discount, root_discount, samples, found = _discount(sums["once"], sums["twice"]), 0.5, [], _found(state)
    copies = [fixed.withColumn("round", F.lit(0))]
    for k in range(1, ROUNDS + 1):
        step = _sampled(shards, discount, root_discount, root_total, root_tables, vocabulary, seed + k)
        state = staged(fixed.groupBy("shard").cogroup(found.drop("seats").groupBy("shard")).applyInArrow(step, STATE), "state")
        sums, found = _totals(state), _found(state)
        root_total, root_tables = float(sums["n_seats"]), float(sums["n_words"])
        if k > 1:
            found = staged(found, "found")
            samples.append({"round": k, "discount": discount, "root_discount": root_discount, "root_total": root_total, "root_tables": root_tables})
            copies.append(found.withColumn("round", F.lit(k)))
        else:
            root_discount = _discount(sums["once"], sums["twice"])
    # a row a shard: broadcast, so that the blocks are not dealt by shard first
    size = own.select("shard", F.greatest(F.lit(1), F.ceil(F.col("n_posts") * 4 / SCORE_BYTES)).cast("int").alias("salts"))
    asked = texts.mapInArrow(_blocks(shards, True), POSTS)
    dealt = asked.join(F.broadcast(size), "shard").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")).drop("salts")
    states = copies[0]
    for more in copies[1:]:
        states = states.unionByName(more, allowMissingColumns=True)
    states = states.join(F.broadcast(size), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    parts = dealt.groupBy("shard", "salt").cogroup(states.groupBy("shard", "salt")).applyInArrow(_scored(samples, vocabulary, total), PARTS)
    out = parts.groupBy("block").applyInArrow(_summed, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
