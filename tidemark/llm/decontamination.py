"""Benchmark decontamination with a distributed positional inverted index.

The index has a row for each term and document, with the term's positions. A window of an item is looked
up from its two rarest terms (by corpus counts): their lists, moved by the terms' offsets, are intersected,
and where they meet the whole item is laid against the document to give exact matches.

Only lists of terms that a lookup asks for are stored; a broadcast of those terms cuts the rest off while
texts are read. It is used up to BROADCAST_TERMS terms; beyond, all lists are stored and joined instead.

Null texts have no words: no windows, no hits. Items with equal texts are items of their own. Repeated
document rows get a row each (rows equal in id and text share one lookup); an empty corpus gives an empty
result, an empty benchmark no hits. Rows with a null doc_id are looked up like others. Texts are used whole; extra columns are not carried.
Of equally rare words of a window any two may be asked for: every window that occurs holds them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.session import bound_batches, same_document, settle, small

WINDOW = 13
BROADCAST_TERMS = 1 << 20


def _terms(words: DataFrame):
    """A broadcast of the distinct terms, sorted; None if they are too many for one."""
    words = words.select("term").distinct()
    if words.count() > BROADCAST_TERMS:
        return None
    return words.sparkSession.sparkContext.broadcast(np.sort(words.toPandas()["term"].to_numpy(dtype=np.int64)))


def _among(keys: np.ndarray, terms) -> np.ndarray:
    if terms is None:
        return np.ones(len(keys), dtype=bool)
    if not len(terms.value):
        return np.zeros(len(keys), dtype=bool)
    return terms.value[np.minimum(np.searchsorted(terms.value, keys), len(terms.value) - 1)] == keys


def _lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of values that begin at each of cut."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([cut, [len(values)]]).astype(np.int32)), pa.array(values, kind))


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words array<long>: the hashes of each item's words in order; items without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, first, hashes, *_ in T.iter_words(b.column(1), T.ALNUM):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], _lists(hashes.view(np.int64), first[:-1], pa.int64())], names=["item_id", "words"])

    kind = items.schema[item_id].dataType.simpleString()
    return items.select(item_id, text).mapInArrow(run, f"item_id {kind}, words array<long>").where("size(words) > 0")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def word_counts(docs: DataFrame, terms) -> DataFrame:
    """A row (doc_id, version, n_words) for each row of docs, and rows (term, n) with counts of the terms by partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "version", "n_words", "term", "n"]
        keys, total, doc_type = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
        for b in batches:
            doc_type = b.column(0).type
            for i, j, first, hashes, *_ in T.iter_words(b.column(2), T.ALNUM):
                m = j - i
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], pa.array(np.diff(first).astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                key = hashes.view(np.int64)
                k, n = np.unique(key[_among(key, terms)], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                total = np.bincount(at, np.concatenate([total, n]), len(keys)).astype(np.int64)
            if len(keys) > BROADCAST_TERMS:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), doc_type), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(total)], names=names)
                keys = total = np.zeros(0, dtype=np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), doc_type), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(total)], names=names)

    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, version long, n_words long, term long, n long")


def postings(docs: DataFrame, terms=None) -> DataFrame:
    """The index: term, doc_id, version, positions array<int> (ascending, in words); of all terms, or of those broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, first, hashes, *_ in T.iter_words(b.column(2), T.ALNUM):
                key = hashes.view(np.int64)
                at = np.flatnonzero(_among(key, terms))
                if not len(at):
                    continue
                of = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((at, key[at], of))
                at, of = at[order], of[order]
                term = key[at]
                cut = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
                pick = pa.array(i + of[cut])
                yield pa.RecordBatch.from_arrays([pa.array(term[cut]), b.column(0).take(pick), b.column(1).take(pick), _lists((at - first[of]).astype(np.int32), cut, pa.int32())], names=["term", "doc_id", "version", "positions"])

    return _keyed(docs).mapInArrow(run, f"term long, doc_id {kind}, version long, positions array<int>")


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, p1, term1, p2, term2: for every window its rarest word and the next rarest, by position in the item.

    Windows with a word that no document has are left out.
    """
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, words, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                pairs = set()
                for s in range(max(1, len(words) - window + 1)):
                    ranked = sorted(range(s, min(s + window, len(words))), key=lambda p: (n[p], words[p], p))
                    if n[ranked[0]] > 0:
                        other = next((p for p in ranked if words[p] != words[ranked[0]]), ranked[-1])
                        pairs.add((ranked[0], other))
                out += [(item, p, words[p], q, words[q]) for p, q in sorted(pairs)]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["item_id", "p1", "term1", "p2", "term2"])

    each = items.select("item_id", "words", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    listed = each.groupBy("item_id", "words").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("n"))
    return listed.mapInArrow(run, f"item_id {kind}, p1 int, term1 long, p2 int, term2 long").distinct()


def _both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of first with the list that their document has for the second word."""
    return first.join(second, (first["term2"] == second["term2"]) & same_document(first, second)).drop(second["term2"], second["doc_id"], second["version"])


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """item_id, doc_id, version, at: where a document has both words of a pair at their offsets (at: the item's start, maybe negative)."""
    first = index.select(F.col("term").alias("term1"), "doc_id", "version", F.col("positions").alias("list1"))
    second = index.select(F.col("term").alias("term2"), "doc_id", "version", F.col("positions").alias("list2"))
    met = _both(pairs.join(first, "term1"), second)
    moved = F.array_intersect(F.transform("list1", lambda x: x - F.col("p1")), F.transform("list2", lambda x: x - F.col("p2")))
    return met.select("item_id", "doc_id", "version", F.explode(moved).alias("at")).distinct()


def near(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """query_id, doc_id, version, at: proximity matches, where term2 stands within `slop` words of term1's position `at`, before or after.

    pairs: query_id, term1, term2 (hashes as in the index).
    """
    first = index.select(F.col("term").alias("term1"), "doc_id", "version", F.col("positions").alias("list1"))
    second = index.select(F.col("term").alias("term2"), "doc_id", "version", F.col("positions").alias("list2"))
    met = _both(pairs.select("query_id", "term1", "term2").join(first, "term1"), second)
    close = F.filter("list1", lambda x: F.exists("list2", lambda y: (x != y) & (F.abs(x - y) <= slop)))
    return met.select("query_id", "doc_id", "version", F.explode(close).alias("at"))


def phrase_hits(docs: DataFrame, items: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, version, n_hit, items: exact matches at the alignments found; a document word in any window that occurs is hit once."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    told = found.join(items, "item_id").groupBy("doc_id", "version").agg(F.collect_list(F.struct("item_id", "at", "words")).alias("told"))
    # few texts have an alignment: the others are left where they are
    hit = small(settle(found.select("doc_id", "version").distinct(), "hit-documents"))
    texts = _keyed(docs.where(F.col("text").isNotNull()))
    texts = texts.join(hit, same_document(texts, hit), "left_semi")
    joined = texts.join(told, same_document(texts, told)).select(texts["doc_id"], texts["version"], "text", "told")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, n_hit, hit_items = b.column(3), [], []
            for i, j, first, hashes, *_ in T.iter_words(b.column(2), T.ALNUM):
                for k in range(j - i):
                    doc = hashes[first[k] : first[k + 1]].view(np.int64)
                    covered, names = np.zeros(len(doc) + 1, dtype=np.int64), set()
                    for x in told[i + k].as_py():
                        words, at = np.array(x["words"], dtype=np.int64), x["at"]
                        size = min(window, len(words))
                        lo, hi = max(0, -at), min(len(words), len(doc) - at)
                        if hi - lo < size:
                            continue
                        run_of = np.concatenate([[0], np.cumsum(doc[at + lo : at + hi] == words[lo:hi])])
                        start = np.flatnonzero(run_of[size:] - run_of[:-size] == size) + at + lo
                        if len(start):
                            names.add(x["item_id"])
                            np.add.at(covered, start, 1)
                            np.add.at(covered, start + size, -1)
                    n_hit.append(int((np.cumsum(covered)[:-1] > 0).sum()))
                    hit_items.append(sorted(names, key=str))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(hit_items, pa.list_(told.type.value_type.field("item_id").type))], names=["doc_id", "version", "n_hit", "items"])

    return joined.mapInArrow(run, f"doc_id {kind}, version long, n_hit long, items array<{item_kind}>").where("n_hit > 0").dropDuplicates(["doc_id", "version"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, version, n_words, n_hit, items array: a row for each row of docs; version tells texts under one id apart."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    items = settle(item_words(benchmark), "items")
    counted = settle(word_counts(docs, _terms(items.select(F.explode("words").alias("term")))), "word-counts")
    counts = counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    pairs = settle(anchors(items, counts, window), "anchors")
    asked = _terms(pairs.select(F.col("term1").alias("term")).union(pairs.select("term2")))
    index = settle(postings(docs, asked), "postings")
    found = settle(alignments(index, pairs), "alignments")
    hits = phrase_hits(docs, items, found, window)
    rows = counted.where("term is null").select("doc_id", "version", "n_words")
    return rows.join(hits, same_document(rows, hits), "left").select(rows["doc_id"], rows["version"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast(hits.schema["items"].dataType)).alias("items"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def item_list(items: str = "items"):
    return F.array_join(F.array_sort(F.transform(F.col(items), lambda x: x.cast("string"))), ",")
