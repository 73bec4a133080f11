"""Retrieval: exact signatures, words with BM25, filters, and both merged with explained ranks."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.tables import settle
from tidemark.schema import OUTCOMES

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
EXACT_BPS, TEXT_BPS = 10_000, 5_000
TIE_BREAK = "score desc, bm25 asc, occurred_at desc, event_id asc"


def _folds() -> tuple[str, str, str]:
    """Letters with marks and their bases, and the marks alone: by the rule of canonical decomposition."""
    marked, bases = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(chr(code))
            bases.append(parts[0])
    return "".join(marked), "".join(bases), "".join(map(chr, range(0x300, 0x370)))


_MARKED, _BASES, _MARKS = _folds()


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, without diacritics, in order."""
    plain = F.translate(F.lower(text), _MARKED + _MARKS, _BASES)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def filtered(events: DataFrame, project: str | None = None, since=None, types: Sequence[str] = (), outcome: str | None = None) -> DataFrame:
    """events under all filters given, which are echoed in applied_filters."""
    told = []
    if project is not None:
        events, told = events.where(F.col("project") == project), [*told, f"project={project}"]
    if since is not None:
        events, told = events.where(F.col("occurred_at") >= F.lit(since).cast("timestamp")), [*told, f"since={since}"]
    if types:
        events, told = events.where(F.col("type").isin(*types)), [*told, "event_kind=" + ",".join(types)]
    if outcome is not None:
        events, told = events.where(F.col("type").isin(*OUTCOMES[outcome])), [*told, f"outcome={outcome}"]
    return events.withColumn("applied_filters", F.array(*(F.lit(x) for x in told)).cast("array<string>"))


def by_signature(ops: DataFrame, signature: str) -> DataFrame:
    return ops.where(F.col("operation_key") == signature)


def bm25(docs: DataFrame, doc: str, text: Column, terms: Sequence[str], excluded: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """doc, bm25 (lower is better) of documents that hold all terms and prefixes and no excluded word.

    Only counts of the words asked for leave a document; its other words count in its length alone.
    """
    asked = [F.lit(t) for t in terms] + [F.lit(p) for p in prefixes]
    if not asked:
        raise ValueError("a query needs a word")
    listed = docs.select(F.col(doc), words(text).alias("w"))
    is_prefix = [False] * len(terms) + [True] * len(prefixes)
    tf = F.array(*(F.size(F.filter("w", (lambda q: lambda x: x.startswith(q))(t) if p else (lambda q: lambda x: x == q)(t))) for t, p in zip(asked, is_prefix)))
    bad = F.arrays_overlap("w", F.array(*(F.lit(x) for x in excluded))) if excluded else F.lit(False)
    # a few numbers for each document: texts are cut into words once, for the statistics and the hits
    counted = settle(listed.select(doc, F.size("w").alias("dl"), tf.alias("tf"), bad.alias("bad")), "word-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(asked)))).withColumn("one", F.lit(1))
    hits = counted.where(~F.col("bad") & F.forall("tf", lambda x: x > 0)).withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")  # stats: one row
    parts = [F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(LEAST_IDF)) * F.col("tf")[k] * (K1 + 1) / (F.col("tf")[k] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) for k in range(len(asked))]
    return hits.select(doc, (-sum(parts[1:], parts[0])).alias("bm25"))


def _hits(w: Column, unit: str | tuple[str, ...]) -> Column:
    """How often a unit stands in a list of words: a word, a beginning (with a * at its end) or a phrase."""
    if isinstance(unit, str):
        return F.size(F.filter(w, (lambda x: x.startswith(unit[:-1])) if unit.endswith("*") else (lambda x: x == unit)))
    n = len(unit)
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(w, i, n) == F.array(*(F.lit(x) for x in unit))))


def _close(w: Column, first: str, second: str, within: int) -> Column:
    """Whether two words stand with at most `within` words between them."""
    places = lambda t: F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.get(w, i - 1) == t)
    return F.exists(places(first), lambda i: F.exists(places(second), lambda j: (i != j) & (F.abs(i - j) <= within + 1)))


def search(docs: DataFrame, doc: str, text: Column | dict[str, Column], any_of: Sequence[Sequence[str | tuple[str, ...]]], none_of: Sequence[str | tuple[str, ...]] = (), near: Sequence[tuple[str, str, int]] = (), columns: Sequence[str] = ()) -> DataFrame:
    """doc, bm25 (lower is better) of documents that hold a unit of every group of any_of, none of none_of, and all pairs of near.

    A unit is a word, a beginning (word*) or a phrase (a tuple). text is one column, or several by name, of which
    `columns` are searched. Units that a document need not hold count where it does.
    """
    units = list(dict.fromkeys(u for group in any_of for u in group))
    if not units:
        raise ValueError("a query needs a word")
    texts = {"": text} if not isinstance(text, dict) else {name: c for name, c in text.items() if not columns or name in columns}
    # a list of words for each column: phrases and nearness end where a column does
    lists = [F.coalesce(words(c), F.array().cast("array<string>")) for c in texts.values()]
    listed = docs.select(F.col(doc), F.array(*lists).alias("w"))
    count = lambda u: F.aggregate(F.transform("w", lambda w: _hits(w, u)), F.lit(0), lambda a, n: a + n)
    tf, length = F.array(*(count(u) for u in units)), F.aggregate("w", F.lit(0), lambda n, w: n + F.size(w))
    fits = F.lit(True)
    for u in none_of:
        fits = fits & (count(u) == 0)
    for first, second, k in near:
        fits = fits & F.exists("w", (lambda a, b, k: lambda w: _close(w, a, b, k))(first, second, k))
    counted = settle(listed.select(doc, length.alias("dl"), tf.alias("tf"), fits.alias("fits")), "word-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(units)))).withColumn("one", F.lit(1))
    wanted = F.col("fits")
    for group in any_of:
        some = F.lit(False)
        for u in group:
            some = some | (F.col("tf")[units.index(u)] > 0)
        wanted = wanted & some
    hits = counted.where(wanted).withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")  # stats: one row
    parts = [F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(LEAST_IDF)) * F.col("tf")[k] * (K1 + 1) / (F.col("tf")[k] + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) for k in range(len(units))]
    return hits.select(doc, (-sum(parts[1:], parts[0])).alias("bm25"))


def best(hits: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """Hits (event_id, bm25) in the order of a plain search: best first, then the earlier event."""
    return hits.join(events.select("event_id", "occurred_at"), "event_id").orderBy("bm25", "occurred_at", "event_id").limit(limit)


def clean_snippet(text: Column) -> Column:
    """A snippet for one line: the value of `command` if it shows one, else the text without braces and quotes; blanks are one space."""
    value = F.regexp_extract(text, r'(?s)command[^:]*:[^"]*"((?:\\.|[^"\\])*)', 1)
    plain = F.regexp_replace(F.regexp_replace(value, r"\\[ntr]", " "), r"\\([\\\"])", "$1")
    one_line = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(one_line(plain)) > 0, one_line(plain)).otherwise(one_line(F.regexp_replace(text, r'[{}"]', "")))


def phrase(docs: DataFrame, doc: str, text: Column, phrase_words: Sequence[str]) -> DataFrame:
    """doc, at: where the words stand in a row (at counts words from 0)."""
    listed = docs.select(F.col(doc), words(text).alias("w"))
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - len(phrase_words)), lambda i: F.slice(F.col("w"), i + 1, len(phrase_words)) == F.array(*(F.lit(x) for x in phrase_words)))
    return listed.where(F.size("w") >= len(phrase_words)).select(doc, F.explode(starts).alias("at"))


def snippet(text: Column, terms: Sequence[str], size: int = 16) -> Column:
    """`size` words around the first hit, hits in brackets, an ellipsis where words are cut off."""
    shown = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    plain = F.transform(shown, lambda w: F.array_join(words(w), ""))
    hit = [F.lit(t) for t in terms]
    first = F.coalesce(F.array_min(F.filter(F.transform(F.array(*hit), lambda t: F.array_position(plain, t)), lambda p: p > 0)), F.lit(1)).cast("int")
    start = F.greatest(F.lit(1), first - size // 2)
    marked = F.transform(F.slice(F.arrays_zip(shown.alias("a"), plain.alias("b")), start, F.lit(size)), lambda x: F.when(F.array_contains(F.array(*hit), x["b"]), F.concat(F.lit("["), x["a"], F.lit("]"))).otherwise(x["a"]))
    return F.concat(F.when(start > 1, "… ").otherwise(""), F.array_join(marked, " "), F.when(F.size(shown) >= start + size, " …").otherwise(""))


def merged(exact: DataFrame | None, text: DataFrame | None, events: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of both kinds by event, classified before they are cut to `limit`.

    exact: event_id; text: event_id, bm25; events: event_id, occurred_at. A limit of 0 gives no rows.
    """
    if exact is None and text is None:
        raise ValueError("a search needs a signature or words")
    spark = events.sparkSession
    exact = spark.createDataFrame([], "event_id string") if exact is None else exact.select("event_id").distinct()
    text = spark.createDataFrame([], "event_id string, bm25 double") if text is None else text.select("event_id", "bm25")
    both = exact.withColumn("by_signature", F.lit(True)).join(text.withColumn("by_text", F.lit(True)), "event_id", "full_outer")
    score = F.when(F.col("by_signature"), EXACT_BPS).otherwise(0) + F.when(F.col("by_text"), TEXT_BPS).otherwise(0)
    kind = F.when(F.col("by_signature") & F.col("by_text"), "signature_and_full_text").when(F.col("by_signature"), "exact_signature").otherwise("full_text")
    ranked = both.join(events.select("event_id", "occurred_at"), "event_id").select("event_id", "occurred_at", score.alias("score_bps"), kind.alias("match_kind"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
    return ranked.orderBy(F.desc("score_bps"), F.asc("bm25"), F.desc("occurred_at"), F.asc("event_id")).limit(limit)


def explained(hits: DataFrame) -> DataFrame:
    """hits with an explanation: version, signals with their points, tie break."""
    signals = F.array_compact(F.array(F.when(F.col("match_kind") != "full_text", F.struct(F.lit("exact_signature").alias("signal"), F.lit(EXACT_BPS).alias("bps"))), F.when(F.col("match_kind") != "exact_signature", F.struct(F.lit("full_text").alias("signal"), F.lit(TEXT_BPS).alias("bps")))))
    return hits.withColumn("explanation", F.struct(F.lit("retrieval/0.1").alias("spec_version"), signals.alias("signals"), F.lit(TIE_BREAK).alias("tie_break")))
