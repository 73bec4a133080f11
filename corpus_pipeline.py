"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the docs of the next one. All but the last return the columns of documents, and any others that docs has,
whatever their names. Rows with a null doc_id, null, empty and very long texts pass through like any others: null
and empty texts have a quality score, are no one's near-duplicate, have no benchmark words, secrets or tokens. Of
rows with equal id and text the least one stays (by its columns as JSON), without words all; an empty table stays empty. ORACLE_SQL is None: trained scores and BPE are beyond SQL, so tests hold each stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, gam, ngram_join, queries, secrets
from tidemark.llm.session import packed, same_document, settle, small, table, unpacked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is trained on labelled rows of docs."""
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    rows = packed(docs).select("row", F.col("row").getField("text").alias("text"))
    return unpacked(gam.score(rows, model, keep=["row"]).where("predicted = 1"), docs)


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs without (or, left_semi: only) the rows of the (doc_id, version) pairs in a settled table."""
    rows, gone = packed(docs), small(gone.select("doc_id", "version"))
    return unpacked(rows.join(gone, rows["version"].eqNullSafe(gone["version"]) & rows["doc_id"].eqNullSafe(gone["doc_id"]), how), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group whose shingle sets are linked (five words, 0.8); texts without words all stay.

    Rows without an id go where their group has a document with one; a group without any id keeps its different texts.
    """
    found = settle(ngram_join.similar_documents(docs), "groups")
    worded = found.where("n_shingles > 0 and component_id is not null")
    firsts = worded.where("doc_id = component_id").groupBy("component_id").agg(F.min("version").alias("first"))
    gone = settle(worded.join(firsts, "component_id").where("not (doc_id <=> component_id) or version <> first").select("doc_id", "version").distinct(), "near-duplicates")
    kept = _without(docs, gone)
    again = settle(found.join(gone, same_document(found, gone), "left_anti").where("n_shingles > 0").groupBy("doc_id", "version").count().where("count > 1").select("doc_id", "version"), "repeated-rows")
    if again.isEmpty():
        return kept
    once = _without(kept, again, "left_semi")
    least = packed(once).groupBy("doc_id", "version").agg(F.min_by("row", F.to_json("row")).alias("row"))  # whatever runs, the same row stays
    return _without(kept, again).unionByName(unpacked(least, docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not hit."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, settle(found.where(decontamination.contaminated()).select("doc_id", "version").distinct(), "contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew."""
    masked = secrets.redact(docs, secrets.extend_ledger(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe.digest(docs, bpe.read_vocabulary(queries.vocabulary_path()))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("secrets", secret_scan), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
