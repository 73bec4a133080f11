"""A stored positional inverted index, and the MATCH language over it.

A posting is a row (term, column, document, positions), so that no list has to fit into a row; it also has the document's length.
Postings are dealt to buckets by the first letters of the term and sorted inside, so that words and beginnings of words read one
bucket each, and of it what the term's bounds leave. A query reads the postings of its own terms only, gathers them by document, and
decides phrases, nearness and the boolean structure there; phrases and NEAR groups never cross columns.

Language: words (all must match), "phrases", first + second (a phrase), word* (a beginning), ^word (at the start of a column),
column : ..., {one two} : ..., - column : ..., NEAR(a "b c", 5), parentheses, and the operators NOT, AND, OR in upper case, which
bind in this order; words side by side bind most tightly.

Null texts have no words; a null document id is an id like others. Documents that are indexed twice in one build are one
document with the words of both. Ranks are BM25 over phrases (k1 1.2, b 0.75), lower is better.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.commits import Snapshot, Tables, bucket
from tidemark.operators.retrieve import B, K1, LEAST_IDF, words
from tidemark.operators.tables import settle

LEAD = 2
NEAR_DISTANCE = 10
INDEX_KEYS = {"postings": ["lead"]}


# ---- the index


def postings(docs: DataFrame, doc: str, columns: dict[str, Column]) -> DataFrame:
    """lead, term, column, doc, positions (from 0), length (words of the document in all columns)."""
    listed = docs.select(F.col(doc).alias("doc"), *(F.coalesce(words(c), F.array().cast("array<string>")).alias(n) for n, c in columns.items()))
    length = sum((F.size(F.col(n)) for n in columns), F.lit(0)).cast("long")
    each = F.explode(F.flatten(F.array(*(F.transform(F.col(n), (lambda n: lambda w, i: F.struct(w.alias("term"), F.lit(n).alias("column"), i.alias("at")))(n)) for n in columns))))
    rows = listed.select("doc", length.alias("length"), each.alias("w")).select("doc", "length", "w.*")
    return rows.groupBy("term", "column", "doc").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.max("length").alias("length")).select(F.substring("term", 1, LEAD).alias("lead"), "term", "column", "doc", "positions", "length")


def statistics(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """documents, words: one row."""
    length = sum((F.coalesce(F.size(words(c)), F.lit(0)) for c in columns.values()), F.lit(0))
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(length), F.lit(0)).alias("words"))


def write(tables: Tables, docs: DataFrame, doc: str, columns: dict[str, Column], anew: bool = True) -> Snapshot:
    """Index docs: in place of what is indexed, or as more documents beside it."""
    frames = {"postings": postings(docs, doc, columns), "statistics": statistics(docs, columns)}
    base = tables.snapshot()
    notes = {"columns": list(columns)}
    if anew:
        return tables.commit(base, replace=frames, notes=notes, keys=INDEX_KEYS)
    if base.notes.get("columns", notes["columns"]) != notes["columns"]:
        raise ValueError("an index has the same columns for all its documents")
    return tables.commit(base, append=frames, notes=notes, keys=INDEX_KEYS)


# ---- the language


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    columns: frozenset | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int
    columns: frozenset | None = None


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\x1a]+)|([-+*^:(){},]))')


def _cut(text: str) -> tuple[str, ...]:
    """Words of a string as `words` finds them in a column."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return tuple(w for w in re.split(r"[^\w]+|_", plain) if w)


class _Query:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.tokens, at = columns, [], 0
        while text[at:].strip():
            met = _TOKEN.match(text, at)
            if met is None:
                raise ValueError(f"syntax error near {text[at:].strip()[:20]!r}")
            quoted, word, sign = met.groups()
            self.tokens.append(("string", quoted.replace('""', '"')) if quoted is not None else ("word", word) if word else ("sign", sign))
            at = met.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str | None:
        got = self.peek()
        if got[0] == kind and value in (None, got[1]):
            self.at += 1
            return got[1]
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        got = self.take(kind, value)
        if got is None:
            raise ValueError(f"syntax error near {self.peek()[1]!r}: {value or kind} expected")
        return got

    def either(self):
        parts = [self.both()]
        while self.take("word", "OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def both(self):
        parts = [self.without()]
        while self.take("word", "AND"):
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def without(self):
        left = self.beside()
        while self.take("word", "NOT"):
            left = Op("not", (left, self.beside()))
        return left

    def beside(self):
        parts = [self.item(None)]
        while (t := self.peek())[0] == "string" or (t[0] == "word" and t[1] not in ("AND", "OR", "NOT")) or t in (("sign", "("), ("sign", "^"), ("sign", "{"), ("sign", "-")):
            parts.append(self.item(None))
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def filter_(self) -> frozenset | None:
        """A column filter, if one stands here."""
        start, against = self.at, self.take("sign", "-") is not None
        names = []
        if self.take("sign", "{"):
            while not self.take("sign", "}"):
                names.append(self.take("word") or self.need("string"))
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            names.append(self.tokens[self.at][1])
            self.at += 1
        if not names or not self.take("sign", ":"):
            if against or names:
                raise ValueError(f"syntax error near {self.peek()[1]!r}: a column filter expected")
            self.at = start
            return None
        if unknown := set(names) - set(self.columns):
            raise ValueError(f"no such column: {sorted(unknown)[0]}")
        return frozenset(self.columns) - frozenset(names) if against else frozenset(names)

    def item(self, columns: frozenset | None):
        own = self.filter_()
        columns = columns if own is None else own if columns is None else columns & own
        if own is not None:
            return self.item(columns)
        if self.take("sign", "("):
            inner = self.either()
            self.need("sign", ")")
            return _within(inner, columns)
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            phrases, distance = [], NEAR_DISTANCE
            while not self.take("sign", ")"):
                if self.take("sign", ","):
                    distance = int(self.need("word"))
                    self.need("sign", ")")
                    break
                phrases.append(self.phrase(columns))
            return Near(tuple(phrases), distance, columns)
        return self.phrase(columns)

    def said(self) -> tuple[str, ...]:
        quoted = self.take("string")
        return _cut(self.need("word") if quoted is None else quoted)

    def phrase(self, columns: frozenset | None) -> Phrase:
        if self.peek() in (("word", "AND"), ("word", "OR"), ("word", "NOT")):
            raise ValueError(f"syntax error near {self.peek()[1]!r}")
        initial = self.take("sign", "^") is not None
        said = [*self.said()]
        while self.take("sign", "+"):
            said += self.said()
        return Phrase(tuple(said), self.take("sign", "*") is not None, initial, columns)


def _within(part, columns: frozenset | None):
    """A part of a query under a column filter that stands before its parentheses."""
    if columns is None:
        return part
    if isinstance(part, Op):
        return Op(part.kind, tuple(_within(p, columns) for p in part.parts))
    held = columns if part.columns is None else part.columns & columns
    return Phrase(part.words, part.prefix, part.initial, held) if isinstance(part, Phrase) else Near(tuple(_within(p, columns) for p in part.phrases), part.distance, held)


def parse(text: str, columns: list[str]):
    """The structure of a query; a blank one, or one that doesn't follow the language, is an error."""
    if not text.strip():
        raise ValueError("a query needs a word")
    query = _Query(text, columns)
    found = query.either()
    if query.peek()[0] != "end":
        raise ValueError(f"syntax error near {query.peek()[1]!r}")
    if not _phrases(found):
        raise ValueError("a query needs a word")
    return found


def _occurrences(part) -> list[tuple[Phrase, Near | None]]:
    """All phrases with words, in order, with the NEAR group they stand in."""
    if isinstance(part, Phrase):
        return [(part, None)] if part.words else []
    if isinstance(part, Near):
        return [(p, part) for p in part.phrases if p.words]
    return [x for p in part.parts for x in _occurrences(p)]


def _phrases(part) -> list[Phrase]:
    return [p for p, _ in _occurrences(part)]


# ---- the search


def _positions(found: Column, word: str, prefix: bool, column: str) -> Column:
    own = F.filter(found, lambda x: (x["column"] == column) & (x["term"].startswith(word) if prefix else x["term"] == word))
    return F.flatten(F.transform(own, lambda x: x["positions"]))


def _starts(found: Column, phrase: Phrase, column: str) -> Column:
    """Where a phrase begins in a column: the words' lists, moved by their place in the phrase, intersected."""
    lists = [F.transform(_positions(found, w, phrase.prefix and k == len(phrase.words) - 1, column), (lambda k: lambda p: p - k)(k)) for k, w in enumerate(phrase.words)]
    both = reduce(F.array_intersect, lists)
    return F.filter(both, lambda p: p == 0) if phrase.initial else both


def _clumped(starts: list[Column], lengths: list[int], distance: int) -> list[Column]:
    """The starts of each phrase that stand in a clump: all phrases, with at most `distance` words from the end of the first to the start of the last."""

    def within(p: Column, n: int, q: Column) -> Column:
        return (q >= p) & (q - p - n <= distance)

    def leads(p: Column, i: int) -> Column:
        return reduce(lambda a, b: a & b, (F.exists(o, lambda q: within(p, lengths[i], q)) for k, o in enumerate(starts) if k != i), F.lit(True))

    firsts = [F.filter(own, lambda p: leads(p, i)) for i, own in enumerate(starts)]  # read at once, so that i is that of the loop
    kept = lambda k: F.filter(starts[k], lambda q: reduce(lambda a, b: a | b, (F.array_contains(first, q) if i == k else F.exists(first, lambda p: within(p, lengths[i], q)) for i, first in enumerate(firsts))))
    return [kept(k) for k in range(len(starts))]


def _asked(found: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """Postings of the words of the phrases."""
    exact = sorted({w for p in phrases for k, w in enumerate(p.words) if not (p.prefix and k == len(p.words) - 1)})
    begins = sorted({p.words[-1] for p in phrases if p.prefix})
    wanted = F.col("term").isin(exact) if exact else F.lit(False)
    for b in begins:
        wanted = wanted | F.col("term").startswith(b)
    return found.where(wanted)


def matches(found: DataFrame, stats: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """doc, bm25 of the documents that match, from postings and statistics."""
    tree = parse(query, columns)
    phrases = _phrases(tree)
    units = list(dict.fromkeys(phrases))
    by_doc = _asked(found, phrases).groupBy("doc").agg(F.collect_list(F.struct("term", "column", "positions")).alias("found"), F.max("length").alias("length"))
    held = lambda p: [c for c in columns if p.columns is None or c in p.columns]
    # start positions by phrase and column
    starts = F.array(*(F.array(*(_starts(F.col("found"), u, c) if c in held(u) else F.array().cast("array<int>") for c in columns)) for u in units))
    placed = by_doc.select("doc", "length", starts.alias("s"))
    own = {u: k for k, u in enumerate(units)}
    count = lambda lists: F.aggregate(lists, F.lit(0), lambda n, x: n + F.size(x))

    def clumps(near: Near) -> list[list[Column]]:
        """For each phrase of the group its starts in clumps, by column."""
        inside = [p for p in near.phrases if p.words]
        columned = [_clumped([F.col("s")[own[p]][k] for p in inside], [len(p.words) for p in inside], near.distance) for k in range(len(columns))]
        return [[c[k] for c in columned] for k in range(len(inside))]

    said = _occurrences(tree)
    groups = {id(near): iter(clumps(near)) for _, near in said if near is not None}
    tf = [count(F.col("s")[own[p]]) if near is None else count(F.array(*next(groups[id(near)]))) for p, near in said]
    inside = F.array(*(count(F.col("s")[k]) for k in range(len(units))))
    placed = settle(placed.select("doc", "length", F.array(*tf).alias("tf"), inside.alias("n_unit")), "phrase-counts")
    place = iter(range(len(said)))

    def holds(part) -> Column:
        if isinstance(part, Phrase):  # one without words doesn't restrict
            return F.col("tf")[next(place)] > 0 if part.words else F.lit(True)
        if isinstance(part, Near):
            return reduce(lambda a, b: a & b, [F.col("tf")[next(place)] > 0 for p in part.phrases if p.words], F.lit(True))
        sides = [holds(p) for p in part.parts]
        return sides[0] & ~sides[1] if part.kind == "not" else reduce(lambda a, b: a & b if part.kind == "and" else a | b, sides)

    dfs = placed.agg(*(F.count_if(F.col("n_unit")[k] > 0).alias(f"df{k}") for k in range(len(units)))).withColumn("one", F.lit(1))
    known = stats.agg(F.sum("documents").alias("n"), (F.sum("words") / F.sum("documents")).alias("avgdl")).withColumn("one", F.lit(1))
    hits = placed.where(holds(tree)).withColumn("one", F.lit(1)).join(F.broadcast(dfs.join(known, "one")), "one")  # one row
    idf = lambda k: F.greatest(F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)), F.lit(LEAST_IDF))
    parts = [idf(own[p]) * F.col("tf")[k] * (K1 + 1) / (F.col("tf")[k] + K1 * (1 - B + B * F.col("length") / F.col("avgdl"))) for k, (p, _) in enumerate(said)]
    return hits.select("doc", (-sum(parts[1:], parts[0])).alias("bm25"))


def search(index: Snapshot, query: str) -> DataFrame:
    """doc, bm25 of the documents in a stored index that match; only the buckets of the query's words are read."""
    columns = index.notes["columns"]
    leads = sorted({(w[:LEAD], p.prefix and k == len(p.words) - 1 and len(w) < LEAD) for p in _phrases(parse(query, columns)) for k, w in enumerate(p.words)})
    every = any(short for _, short in leads)  # a beginning of one letter has many leads
    numbers = None if every else sorted({r[0] for r in index.spark.createDataFrame([(x,) for x, _ in leads], "lead string").select(bucket("lead")).collect()})
    return matches(index.read("postings", numbers), index.read("statistics"), query, columns)


def reindex(tables: Tables, events: DataFrame, index_tool_input: bool = False, metadata_keys: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Index the search projection of all events anew, whole or not at all: one row of indexed, excluded."""
    from tidemark.operators.store import search_projection

    rows = settle(search_projection(events, index_tool_input, metadata_keys, exclude), "projection")
    write(tables, rows, "event_id", {"tool": F.col("tool_text"), "metadata": F.col("metadata_text")})
    told = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return told(rows, "indexed").join(told(events, "events"), "one").select("indexed", (F.col("events") - F.col("indexed")).alias("excluded"))
