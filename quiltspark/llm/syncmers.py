"""Operator 3 [native]: document fingerprints from closed syncmers.

A text's symbols are its lower-cased words.  A k-mer of ``K`` words is an anchor
if the smallest hash among its inner runs of ``S`` words is that of its first
or its last run.  Whether it is depends on its own words alone, so a passage
has the same anchors wherever it stands.  The fingerprint holds every anchor of
the whole text, however long, each with the number of the word it starts at
(the first, if it repeats); ``KEEP`` is no number but None.  Texts of fewer than
``K`` words have one anchor, of all their words.

Likeness of two fingerprints: of the hashes of both together, the share that
both have at matching places.  Places match when their distance is within a
quarter of the longer text of the median distance, so moved text matches and
scattered chance hits don't.  Two fingerprints without anchors are alike (1.0),
one with and one without are not (0.0).

Only Spark's own functions are used.  Null texts are empty texts.  Rows with
equal ids are ordered by text; null ids come first; the one row of a table is
its own next.  An empty table gives an empty result.  Other columns are dropped
before any name is added, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K, S = 5, 2
KEEP = None  # all anchors: a slice up to None is whole
#: Rows of a range of ids and how many ranges there are at most.
RANGE_ROWS, MAX_RANGES = 2048, 8192
ANCHOR = "array<struct<h:bigint,p:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """All anchors (h, p) by rising hash."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(1), n - (S - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(S)]))
        last = K - S  # of the K - S + 1 runs in a k-mer

        def chosen(r: Column) -> Column:
            edge = lambda i: F.least(F.element_at(r, i), F.element_at(r, i + last))
            inner = lambda i: F.least(*[F.element_at(r, i + j) for j in range(1, last)])
            at = F.filter(F.sequence(F.lit(1), n - (K - 1)), lambda i: edge(i) <= inner(i))
            whole = lambda i: F.xxhash64(*[F.element_at(r, i + j) for j in range(0, last + 1)])
            return F.transform(at, lambda i: F.struct(F.shiftrightunsigned(whole(i), 24).alias("h"), (i - 1).alias("p")))

        one = F.array(F.struct(F.shiftrightunsigned(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)), 24).alias("h"), F.lit(0).alias("p")))
        return F.when(n >= K, let(runs, chosen)).when(n > 0, one).otherwise(F.array().cast(ANCHOR))

    def kept(found: Column) -> Column:
        return F.filter(found, lambda x, i: (i == 0) | (x["h"] != F.element_at(found, F.greatest(i, F.lit(1)))["h"]))

    return let(F.sort_array(let(hashes, of)), kept)


def as_text(found: Column) -> Column:
    """``h.p`` of every anchor, in order of place."""
    return F.array_join(F.transform(F.sort_array(F.transform(found, lambda x: F.struct(x["p"], x["h"]))), lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit("."), x["p"].cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two columns of ``anchors``."""
    tagged = lambda side, t: F.transform(side, lambda x: F.struct(x["h"].alias("h"), F.lit(t).alias("side"), x["p"].alias("p")))

    def moves(m: Column) -> Column:
        """Place in b less place in a of every hash that both have; equal hashes are neighbours in m."""
        at = F.filter(F.sequence(F.lit(1), F.size(m) - 1), lambda i: F.element_at(m, i)["h"] == F.element_at(m, i + 1)["h"])
        moved = F.transform(at, lambda i: F.element_at(m, i + 1)["p"] - F.element_at(m, i)["p"])
        return F.when(F.size(m) > 1, F.sort_array(moved)).otherwise(F.array().cast("array<int>"))

    reach = F.greatest(F.lit(8), F.coalesce(F.greatest(F.array_max(a["p"]), F.array_max(b["p"])), F.lit(0)) / 4)

    def matching(shift: Column) -> Column:
        middle = F.element_at(shift, F.floor((F.size(shift) + 1) / 2).cast("int"))
        bounds = F.struct((middle - reach).alias("low"), (middle + reach).alias("high"))
        return let(bounds, lambda x: F.size(F.filter(shift, lambda s: s.between(x["low"], x["high"]))))

    def share(moved: Column) -> Column:
        both = F.size(a) + F.size(b) - F.size(moved)
        same = F.when(F.size(moved) == 0, F.lit(0)).otherwise(matching(moved))
        return F.when(both == 0, F.lit(1.0)).otherwise(same / both).cast("double")

    return let(let(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), moves), share)


def with_next(docs: DataFrame, columns: list[str], also: dict[str, Column]) -> DataFrame:
    """``docs`` with the columns ``also``, and, as ``next_<column>``, the columns of the row
    with the next doc_id (after the last: the first).

    Rows are dealt by ranges of doc_id, whose bounds are quantiles, in one
    shuffle.  A copy of the first row of each range visits the range before it,
    so that every row finds its next within its range.  ``also`` is worked out
    after the shuffle, which does not carry it."""
    spark = docs.sparkSession
    rows = docs.count()
    n = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(bounds or []))
    if cuts:
        of = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("doc_id"))), F.lit(0))
        of = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(of)
    else:
        of = F.lit(0)
    # at most MAX_RANGES rows
    heads = sorted((r["_range"], r["_head"]["doc_id"]) for r in docs.groupBy(of.alias("_range")).agg(F.min(F.struct("doc_id")).alias("_head")).collect())
    visits = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    kind = T.StructType([T.StructField("_head", T.LongType()), T.StructField("_range", T.IntegerType())])
    visitors = docs.join(F.broadcast(spark.createDataFrame(visits, kind)), F.col("doc_id").eqNullSafe(F.col("_head"))).drop("_head")
    own = docs.withColumn("_range", of.cast("int")).withColumn("_visits", F.lit(False))
    every = own.unionByName(visitors.withColumn("_visits", F.lit(True))).repartition("_range").withColumns(also)
    w = Window.partitionBy("_range").orderBy("_visits", "doc_id", "text")
    nexts = [F.lead(c).over(w).alias(f"next_{c}") for c in columns]
    return every.select(*docs.columns, *also, "_visits", *nexts).filter(~F.col("_visits")).drop("_visits")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_next(texts, ["text", "_a"], {"_a": anchors(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    found = found.withColumn("_edited", edited)
    found = found.withColumn("_b", anchors(F.col("_edited")))
    return found.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_a")).alias("fingerprint"), as_text(F.col("_b")).alias("edited_fingerprint"),
        likeness(F.col("_a"), F.col("_b")).alias("near_edited"), likeness(F.col("_a"), F.col("next__a")).alias("near_next"),
    )
