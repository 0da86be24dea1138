"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstoken, htmltext, jaccardjoin, kdtopk, linededup, nbest, packing, pitmanyor, ranked, simhash, syncmers, tokenstore, toxicity
from .common import id_text_crc, new_path, table

PACK_CAP, PACK_END, STORE_END, N_BEST = 4096, 1, 2, 4


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scores(table(spark, sf_dir, "documents"), id_text_crc() % 7 == 2)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccardjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op4_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtopk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP4_SQL = """
with v as (
  select vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenstore.write_corpus(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), STORE_END)
    rows = tokenstore.read_corpus(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    rows = rows.join(tokenstore.shard_starts(spark, path), ["part", "shard"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.remove_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "n_lines", "n_removed")


OP6_SQL = """
with lines as (
  select doc_id, text, string_split(text, chr(10)) as l from documents
), win_at as (
  select doc_id, l, unnest(range(len(l) - 2)) as pos from lines where len(l) >= 3
), win as (
  select doc_id, pos, [l[pos + 1], l[pos + 2], l[pos + 3]] as w from win_at
  where trim(l[pos + 1] || l[pos + 2] || l[pos + 3], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), ranked as (
  select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as r from win
), covered as (
  select distinct doc_id, pos + k as pos from (select doc_id, pos, unnest([0, 1, 2]) as k from ranked where r > 1)
), line as (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as pos from lines
), cut as (
  select n.doc_id, coalesce(string_agg(n.line, chr(10) order by n.pos) filter (c.pos is null), '') as text,
    count(c.pos) as n_removed, count(*) as n_lines
  from line n left join covered c on n.doc_id = c.doc_id and n.pos = c.pos group by n.doc_id
)
select d.doc_id, case when d.text is null then null else cut.text end as text,
  coalesce(cut.n_lines, 0) as n_lines, coalesce(cut.n_removed, 0) as n_removed
from documents d left join cut on d.doc_id = cut.doc_id
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), PACK_END, PACK_CAP)
    parts = parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(parts, PACK_CAP).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the best segmentation, the scores of the N_BEST best, and a digest of
    what its ids decode to."""
    found = nbest.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), N_BEST)
    scores = F.concat(F.array("score"), F.transform("others", lambda o: o["score"]))
    return found.select(
        "doc_id", "n_pieces", "score", F.crc32("ids").alias("ids_crc32"), F.md5("decoded").alias("decoded_md5"),
        F.array_join(F.transform(scores, lambda s: s.cast("long").cast("string")), " ").alias("best_scores"),
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rated = toxicity.score(docs.select("doc_id", "text"), model)
    return rated.select("doc_id", (id_text_crc() % 5 == 0).alias("held_out"), "score", "predicted")


def op11_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosstoken.alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with d as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents
), total as (
  select count(*) as n_texts, sum(len(terms)) as n_terms from d where len(terms) > 0
), item as (
  select distinct item_id, unnest({_TERMS}) as term from benchmark
), each as (
  select r, unnest(terms) as term from d
), held as (
  select r, term, count(*) as tf from each where term in (select term from item) group by r, term
), weight as (
  select term, cast(floor(1000 * ln(cast(2 * n_texts + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from held, total group by term, n_texts
), long as (
  select r, doc_id, cast(50 + (50 * len(terms) * n_texts) // n_terms as bigint) as m from d, total where len(terms) > 0
), scored as (
  select item_id, long.r, any_value(long.doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from item join weight using (term) join held using (term) join long on held.r = long.r
  group by item_id, long.r
), ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_syncmer_fingerprints": op3_syncmer_fingerprints,
    "op4_kd_top_k": op4_kd_top_k,
    "op5_token_store": op5_token_store,
    "op6_line_dedup": op6_line_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_nbest_pieces": op8_nbest_pieces,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
    "op11_simhash_pigeonring": op11_simhash_pigeonring,
    "op12_cross_tokens": op12_cross_tokens,
    "op13_ranked_search": op13_ranked_search,
}
SQL = {"op4_kd_top_k": OP4_SQL, "op6_line_dedup": OP6_SQL, "op13_ranked_search": OP13_SQL}
