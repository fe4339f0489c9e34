"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, ctw, html_main, imatch, packing, pivots, quality, segmenter, simhash, toxicity
from .common import held, read, remainder


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat_rotation.rotate(read(spark, sf_dir, "conversations"))
    spans = F.transform("masks", lambda m: F.concat_ws("-", m.start.cast("string"), m.end.cast("string")))
    return parts.select(
        "conv_id",
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.col("n_turns").cast("long").alias("n_turns"),
        F.length("dialogue").cast("long").alias("n_chars"),
        F.array_join(spans, ",").alias("masks"),
        F.sha2("dialogue", 256).alias("dialogue_sha256"),
    )


OP1_SQL = """
with t as (
  select conv_id, cast(floor(turn / 64.0) as bigint) as part, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text
  from conversations
), speakers as (select distinct conv_id, role as speaker from t where role <> 'system'),
r as (
  select t.conv_id, s.speaker, t.part, t.turn, t.role, t.text,
    case when t.role = s.speaker then '<|assistant|>' || chr(10) when t.role = 'system' then '<|system|>' || chr(10)
         else '<|user:' || t.role || '|>' || chr(10) end || t.text || '<|end|>' || chr(10) as piece
  from t join speakers s on t.conv_id = s.conv_id
), e as (
  select *, sum(length(piece)) over (partition by conv_id, speaker, part order by turn, role, text rows unbounded preceding) as e from r
)
select conv_id, speaker, part, count(*) as n_turns, cast(sum(length(piece)) as bigint) as n_chars,
  coalesce(string_agg(case when role = speaker then cast(e - length(piece) + 14 as varchar) || '-' || cast(e as varchar) end, ',' order by turn, role, text), '') as masks,
  sha256(string_agg(piece, '' order by turn, role, text)) as dialogue_sha256
from e group by conv_id, speaker, part
"""


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return imatch.against_edits(docs, imatch.lexicon(docs))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, read(spark, sf_dir, "labels"), F.coalesce(remainder("__id", 3) != 1, F.lit(False)))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", held("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "strongest")


def op5_gumbel_segmentations(spark: SparkSession, sf_dir: str, model: str = segmenter.MODEL) -> DataFrame:
    vocabulary = segmenter.Vocabulary.load(model)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    samples = segmenter.encode(docs, vocabulary, k=2, decoded=True)
    return samples.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_p", "perturbed", "log_inclusion", F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP6_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.coalesce(remainder("__id", 5) != 0, F.lit(False)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.best_fit(docs, packing.words("text"), F.col("source"), packing.same_text("text"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_main.extract(read(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# What the block rules come to where a page marks its article and the article holds blocks of text only.
OP9_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) as t from pages),
s as (select page_id, url, regexp_replace(regexp_replace(t, '<(/?(p|h1|ul|li)|br)[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') as t from a),
d as (select page_id, url, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;', chr(39)), '&amp;?', '&', 'g') as t from s),
w as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from d)
select page_id, url, text, cast(length(text) as bigint) as n_chars from w
"""


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(read(spark, sf_dir, "documents"), ~held("doc_id", 7, 2))
    bits = (-F.col("score") / F.lit(0.30102999566398120) / F.col("n_bytes")).alias("bits_per_byte")
    return scored.select("doc_id", held("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_rotation, op2_imatch, op3_simhash_near_dedup, op4_toxicity, op5_gumbel_segmentations, op6_pivot_top_k, op7_quality, op8_best_fit_packing, op9_main_text, op10_context_tree)}

SQL: dict[str, str] = {"op1_chat_rotation": OP1_SQL, "op6_pivot_top_k": OP6_SQL, "op9_main_text": OP9_SQL}
