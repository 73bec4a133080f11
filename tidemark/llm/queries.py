"""The registered queries of this package: each applies its operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, decontamination, embedding_forest, fixity, gam, hard_negatives, ngram_join, ppm, secrets, toxicity, whitening, wrapper_html
from tidemark.llm.session import table


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(decontamination.item_list(), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.extend_ledger(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.span_text(), 256).alias("base_sha256"), secrets.span_text().alias("spans"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counted = ppm.train(docs.where(~ppm.held_out()))
    return ppm.score(docs, model, counted)


def op5_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), width=4, num=85).select("doc_id", "n_shingles", "component_id")


def op6_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_html.extract(table(spark, sf_dir, "pages"))


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, as an archive, against a replica of it with changed, lost and repeated records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    number = F.col("page_id")
    replica = pages.where(F.coalesce(number % 101 != 7, F.lit(True))).withColumn("html", F.when(number % 97 == 5, F.concat("html", F.lit("\ufffd"))).otherwise(F.col("html")))
    replica = replica.withColumn("html", F.explode(F.when(number % 103 == 9, F.array("html", "html")).otherwise(F.array("html"))))
    return fixity.audit(fixity.records(pages), fixity.records(replica))


OP7_SQL = """
with replica as (
  select page_id, url, case when page_id % 97 = 5 then html || chr(65533) else html end as html
  from pages cross join range(2) as t(copy)
  where coalesce(page_id % 101 <> 7, true) and (copy = 0 or page_id % 103 = 9)
), framed as (
  select 'a' as side, page_id, 'WARC/1.0' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'Content-Length: ' || coalesce(strlen(html)::varchar, 'unknown') || n || n || coalesce(html, '') || n || n as record
  from pages, (select chr(13) || chr(10) as n)
  union all
  select 'b', page_id, 'WARC/1.0' || n || 'WARC-Type: response' || n || 'WARC-Target-URI: ' || coalesce(url, '') || n || 'Content-Length: ' || coalesce(strlen(html)::varchar, 'unknown') || n || n || coalesce(html, '') || n || n
  from replica, (select chr(13) || chr(10) as n)
), hashed as (
  select side, page_id as number, sha256(record) as digest, strlen(record) as size, coalesce(page_id, -1) >> 6 as leaf from framed
), leaves as (
  select leaf, sum(size) as bytes from hashed where side = 'a' group by leaf
), ranges as (
  select leaf, bytes, coalesce(sum(bytes) over (partition by leaf >> 6 order by leaf rows between unbounded preceding and 1 preceding), 0) as start from leaves
), counted as (
  select number, digest, leaf, count(*) filter (side = 'a') as n_primary, count(*) filter (side = 'b') as n_replica from hashed group by all
)
select number, digest, n_primary, n_replica, leaf, start::bigint as range_start, bytes::bigint as range_bytes
from counted left join ranges using (leaf) where n_primary <> n_replica
"""


def op8_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()))


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "flagged")


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.score(docs, model).select("doc_id", gam.held_out().alias("held_out"), "score", "predicted")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts look like the template's control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    posed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(posed)))


OP11_SQL = r"""
with turns as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), named as (
  select *, case when conv_id is null then row_number() over () else 0 end as lone from turns
), escaped as (
  select *, replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<next>', '\s') as body,
    coalesce(replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), '<next>', '\s'), ':', '\c'), '\z') as name,
    row_number() over w as k,
    row_number() over w > 1 and lag(role) over w is not distinct from role as goes_on
  from named window w as (partition by conv_id, lone order by turn nulls first, role nulls first, body)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(body) + case when goes_on then 6 else 4 + length(name) + 2 + 8 end)::bigint as formatted_chars
from escaped group by conv_id, lone
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label).drop("anchor_row")


OP13_SQL = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * c::double) for c in embedding] as x
  from embeddings
  where label is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c::double)]) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from vectors a join vectors b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 3
"""


QUERIES = {f.__name__: f for f in (op1_embedding_forest, op2_decontamination, op3_secret_ledger, op4_ppm_scores, op5_ngram_components, op6_wrapper_text, op7_merkle_audit, op8_bpe_codes, op9_toxicity_cnn, op10_quality_gam, op11_chat_format, op12_embedding_whitening, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op7_merkle_audit": OP7_SQL, "op11_chat_format": OP11_SQL, "op13_hard_negatives": OP13_SQL}
