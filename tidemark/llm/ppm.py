"""Language-model scores by prediction by partial matching, beside a unigram base score.

Counts of byte contexts over all training texts form a trie (orders 0 to 5). A byte is coded in the
longest context that the trie holds; if it was not seen there, an escape is coded (method C: the number
of distinct symbols against their count) and the next shorter context decides, with the symbols of the
longer one excluded. As counts are fixed, the log probability of a byte depends on it and the ORDER bytes
before it alone: it is worked out once for each different run of ORDER + 1 bytes.

The trie holds every context of every order, as a table of runs and their counts. Orders up to LOW
(at most 256**LOW contexts each) are broadcast; runs are dealt by the last LOW + 1 bytes before the coded one,
so that all longer contexts of a run are in its own partition. The CONTEXTS most frequent runs are looked up in
each task; all others are joined, counted by text first. Counting covers every training text. Words met in at
least 1/HOT of the training tokens (so at most HOT of them) are looked up in each task; all others are joined.

Texts are lower-cased (A-Z). Null text counts as empty, which has one token, the end. Very long texts are
scored whole. Repeated rows, even of one doc_id, get a row each; an empty table gives none; without
training rows every byte is coded with the same length. A null doc_id counts as held out.
Which of equally frequent runs or words are looked up and which are joined changes no score. Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.session import bound_batches, settle

ORDER, LOW = 5, 2
CONTEXTS = 1 << 20
HOT = 1 << 17
#: A byte that UTF-8 never has: it ends a text, and fills the contexts at its start.
END = 0xFF
#: Stands for the end token among hashes of words.
END_KEY = np.int64(-0x5EED_E11D)
WORD, GRAM = 0, 1
FLUSH = 4_000_000
#: Runs that values are worked out for at a time, and more where they share their last LOW + 1 bytes.
RUNS = 500_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(True))


def _symbols(offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts i..j-1, each with ORDER fillers before and the end after it; where each begins (fillers included)."""
    n = np.diff(offsets[i : j + 1])
    first = np.concatenate([[0], np.cumsum(n + ORDER + 1)])
    out = np.full(first[-1], END, dtype=np.uint8)
    body = data[offsets[i] : offsets[j]]
    out[np.arange(len(body)) + np.repeat(first[:-1] + ORDER - (offsets[i:j] - offsets[i]), n)] = T.FOLD[body]
    return out, first


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + T.CHUNK, side="right")) - 1))
        yield i, j
        i = j


def _grams(symbols: np.ndarray) -> np.ndarray:
    """Of every byte after the fillers at the very start: it and the ORDER before it, as one number."""
    n = len(symbols) - ORDER
    key = np.zeros(n, dtype=np.int64)
    for k in range(ORDER + 1):
        key = key << 8 | symbols[k : k + n]
    return key


def _runs(offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs that end at each byte of texts i..j-1 and at their ends, and the number of the text (from 0) of each."""
    symbols, first = _symbols(offsets, data, i, j)
    real = np.ones(len(symbols) - ORDER, dtype=bool)
    for k in range(ORDER):  # fillers of the later texts code nothing
        real[first[1:-1] + k - ORDER] = False
    return _grams(symbols)[real], np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]) + 1)


class _Counter:
    """Counts of keys, held sorted; add() returns them once there are too many to hold."""

    def __init__(self) -> None:
        self.keys, self.n, self.waiting, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

    def add(self, keys: np.ndarray) -> bool:
        k, n = np.unique(keys, return_counts=True)
        self.waiting.append((k, n))
        self.size += len(k)
        if self.size > FLUSH // 2:
            self.merge()
        return len(self.keys) > FLUSH

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(x for _, x in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.n, self.waiting, self.size = keys[at], np.add.reduceat(n, at) if len(at) else n, [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n
        self.__init__()
        return out


def counts(docs: DataFrame, kinds: tuple[int, ...] = (WORD, GRAM)) -> DataFrame:
    """(kind, key, n): of words by hash, the end token included, and of runs of ORDER + 1 bytes, over the texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {WORD: _Counter(), GRAM: _Counter()}

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, n = held[kind].take()
            for k in range(0, len(keys), 100_000):
                m = len(keys[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, dtype=np.int32)), pa.array(keys[k : k + m]), pa.array(n[k : k + m])], names=["kind", "key", "n"])

        for b in batches:
            offsets, data = T.buffers(b.column(0))
            for i, j, _, hashes, *_ in T.iter_words(b.column(0), T.NOT_SPACE) if WORD in kinds else ():
                if held[WORD].add(np.concatenate([hashes.view(np.int64), np.full(j - i, END_KEY)])):
                    yield from out(WORD)
            for i, j in _pieces(offsets):
                if held[GRAM].add(_runs(offsets, data, i, j)[0]):
                    yield from out(GRAM)
        yield from out(WORD)
        yield from out(GRAM)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """grams: for each order up to LOW all runs of order + 1 bytes and their counts; hot: sorted word hashes and counts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    hot: tuple[np.ndarray, np.ndarray]
    tokens: int
    words: int


def _sorted(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """key and value of a table of bounded size, by key."""
    t = df.select("key", value).toArrow()
    keys, values = t.column("key").to_numpy(), t.column(value).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all counts (kind, key, n): the whole trie, and words."""
    bound_batches(docs.sparkSession)
    found = settle(counts(docs), "ppm-counts")
    words, grams = found.where(F.col("kind") == WORD).select("key", "n"), found.where(F.col("kind") == GRAM).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("n").alias("v")).first()
    levels = []
    for order in range(LOW + 1):  # at most 257 for each of at most 256**LOW contexts
        levels.append(_sorted(grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("key")).agg(F.sum("n").alias("n")), "n"))
    return Model(levels, _sorted(words.where(F.col("n") * HOT >= total["n"]), "n"), int(total["n"]), int(total["v"])), found


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """The contexts of one order: total and kinds of each, and what they leave of the context one shorter by their first byte."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int, shorter: "Level | None"):
        self.grams, self.n = grams, n
        context = grams >> 8
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
        self.contexts, self.kinds = context[first], np.diff(np.concatenate([first, [len(grams)]]))
        self.total = np.add.reduceat(n, first) if len(first) else np.zeros(0, dtype=np.int64)
        if shorter is not None and len(first):
            outer = _at(shorter.contexts, self.contexts & (1 << 8 * (order - 1)) - 1)[0]
            excluded = np.add.reduceat(shorter.n[_at(shorter.grams, grams & (1 << 8 * order) - 1)[0]], first)
            self.left, self.left_kinds = shorter.total[outer] - excluded, shorter.kinds[outer] - self.kinds


def log_values(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Log10 probability of the last byte of each run after the others; levels: by order, with all contexts that end these runs."""
    value, open_, longer = np.zeros(len(keys)), np.arange(len(keys)), np.full(len(keys), -1)
    for order in range(len(levels) - 1, -1, -1):
        level, key = levels[order], keys[open_]
        at, held = _at(level.contexts, key >> 8 & (1 << 8 * order) - 1)
        gram, seen = _at(level.grams, key & (1 << 8 * (order + 1)) - 1)
        total, kinds = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        whole, part = held & (longer < 0), longer >= 0  # without a longer context nothing is excluded
        total[whole], kinds[whole] = level.total[at[whole]], level.kinds[at[whole]]
        if part.any():
            total[part], kinds[part] = levels[order + 1].left[longer[part]], levels[order + 1].left_kinds[longer[part]]
        coded = np.ones(len(key), dtype=np.int64)
        coded[seen] = level.n[gram[seen]]
        coded[~seen] = kinds[~seen]
        told = coded * (total + kinds) > 0
        value[open_[told]] += np.log10(coded[told]) - np.log10((total + kinds)[told])
        longer = np.where(held, at, -1)[~seen]
        open_ = open_[~seen]
    value[open_] -= np.log10(max(257 - len(levels[0].grams), 1))
    return value


def run_values(docs: DataFrame, model: Model, found: DataFrame) -> DataFrame:
    """key, m, value: every run of ORDER + 1 bytes in docs, how often it is met there, and its log probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model.grams)
    asked = counts(docs, (GRAM,)).select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    held = found.where(F.col("kind") == GRAM).select("key", "n", F.lit(0).cast("long").alias("m"))
    both = asked.unionByName(held).groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    group = F.shiftright("key", 8).bitwiseAND((1 << 8 * (LOW + 1)) - 1)
    placed = both.withColumn("group", group).repartition("group").sortWithinPartitions("group").select("key", "n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[Level] = []
        for order, (grams, n) in enumerate(shared.value):
            low.append(Level(grams, n, order, low[-1] if low else None))

        def told(key: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            levels = list(low)
            for order in range(LOW + 1, ORDER + 1):
                gram, of = np.unique(key[n > 0] & (1 << 8 * (order + 1)) - 1, return_inverse=True)
                levels.append(Level(gram, np.bincount(of, n[n > 0], len(gram)).astype(np.int64), order, levels[-1]))
            key, m = key[m > 0], m[m > 0]
            value = log_values(key, levels)
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (key, m, value)], names=["key", "m", "value"])

        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            if sum(len(x[0]) for x in held) >= RUNS:
                key, n, m = (np.concatenate(x) for x in zip(*held))
                of = key >> 8 & (1 << 8 * (LOW + 1)) - 1
                change = np.flatnonzero(of[1:] != of[:-1])
                split = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
                if split:
                    yield from told(key[:split], n[:split], m[:split])
                held = [(key[split:], n[split:], m[split:])]
        if held:
            yield from told(*(np.concatenate(x) for x in zip(*held)))

    return placed.mapInArrow(run, "key long, m long, value double")


def frequent(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The most frequent runs, at most CONTEXTS of them, and all others."""
    size = F.floor(F.log2("m") * 16).cast("int")
    least, room = 0, CONTEXTS
    for r in sorted(values.groupBy(size.alias("size")).count().collect(), reverse=True):  # some hundred rows
        room -= r["count"]
        if room < 0:
            least = r["size"] + 1
            break
    return values.where(size >= least), values.where(size < least)


class Lookup:
    """Values of keys by a hash table of one place each; keys that lost their place are found by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.slot = np.zeros(1 << 64 - int(self.shift), dtype=np.int32)
        self.slot[self._place(keys)] = np.arange(len(keys))
        self.lost = np.flatnonzero(self.slot[self._place(keys)] != np.arange(len(keys)))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there are none, and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        at = self.slot[self._place(keys)]
        held = self.keys[at] == keys
        rest = np.flatnonzero(~held)
        again, ok = _at(self.keys[self.lost], keys[rest])
        at[rest[ok]] = self.lost[again[ok]]
        held[rest[ok]] = True
        return np.where(held, self.values[at], 0.0), held


def _by_text(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, key) pairs and how often each is met."""
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
    return of[cut], keys[cut], np.diff(np.concatenate([cut, [len(keys)]]))


_built: dict[str, Lookup] = {}


def _built_lookup(shared, name: str) -> Lookup:
    if name not in _built:
        _built.clear()
        _built[name] = Lookup(*shared.value[1])
    return _built[name]


def score(docs: DataFrame, model: Model, found: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs."""
    import uuid

    spark = docs.sparkSession
    bound_batches(spark)
    often, rest = frequent(settle(run_values(docs, model, found), "ppm-values"))
    shared, name = spark.sparkContext.broadcast((model.hot, _sorted(often, "value"))), uuid.uuid4().hex
    divisor = float(np.log10(model.tokens + model.words + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, (hot, hot_n) = _built_lookup(shared, name), shared.value[0]
        hot_log, end = np.log10(hot_n + 1.0), np.searchsorted(hot, END_KEY)
        end_known = bool(len(hot)) and end < len(hot) and hot[end] == END_KEY
        for b in batches:
            offsets, data = T.buffers(b.column(2))
            rid, doc = b.column(0), b.column(1)

            def out(pick: np.ndarray, kinds: np.ndarray, keys: np.ndarray, *numbers: np.ndarray) -> pa.RecordBatch:
                at = pa.array(pick)
                return pa.RecordBatch.from_arrays([rid.take(at), doc.take(at), pa.array(kinds.astype(np.int32)), pa.array(keys), *map(pa.array, numbers)], names=["rid", "doc_id", "kind", "key", "times", "n_tokens", "n_known", "base", "score"])

            total = np.zeros(b.num_rows)
            for i, j in _pieces(offsets):
                keys, of = _runs(offsets, data, i, j)
                value, held = lookup.get(keys)
                total[i:j] = np.bincount(of, value, j - i)
                of, keys, times = _by_text(of[~held], keys[~held])
                none, zeros = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys))
                if len(keys):
                    yield out(i + of, np.full(len(keys), GRAM), keys, times, none, none, zeros, zeros)
            for i, j, first, hashes, *_ in T.iter_words(b.column(2), T.NOT_SPACE):
                m, n = j - i, np.diff(first)
                key, of = hashes.view(np.int64), np.repeat(np.arange(m), n)
                at, known = _at(hot, key)
                base = np.bincount(of[known], hot_log[at[known]], m) - (n + 1) * divisor
                n_known = np.bincount(of[known], minlength=m)
                if end_known:
                    base, n_known = base + hot_log[end], n_known + 1
                rare, rare_of = key[~known], of[~known]
                if not end_known:
                    rare, rare_of = np.concatenate([rare, np.full(m, END_KEY)]), np.concatenate([rare_of, np.arange(m)])
                rare_of, rare, times = _by_text(rare_of, rare)
                # a row for the text itself has a key of its own, for an even deal
                own = T.mix(np.asarray(rid[i:j], dtype=np.uint64) + np.uint64(0x9E3779B9)).view(np.int64)
                none, zeros = np.zeros(len(rare), dtype=np.int64), np.zeros(len(rare))
                yield out(
                    i + np.concatenate([np.arange(m), rare_of]), np.full(m + len(rare), WORD), np.concatenate([own, rare]), np.concatenate([np.zeros(m, dtype=np.int64), times]),
                    np.concatenate([n + 1, none]), np.concatenate([n_known, none]).astype(np.int64), np.concatenate([base, zeros]), np.concatenate([total[i:j], zeros]),
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, kind int, key long, times long, n_tokens long, n_known long, base double, score double")
    words = found.where(F.col("kind") == WORD).select("kind", "key", "n", F.lit(0.0).alias("value"))
    facts = words.unionByName(rest.select(F.lit(GRAM).alias("kind"), "key", F.lit(0).cast("long").alias("n"), "value"))
    joined = rows.join(facts, ["kind", "key"], "left")
    met = (F.col("kind") == WORD) & F.col("n").isNotNull() & (F.col("times") > 0)
    summed = joined.groupBy("rid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(met, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(met, F.col("times") * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("base_score"),
        F.sum(F.col("score") + F.col("times") * F.coalesce("value", F.lit(0.0))).alias("score"),
    )
    return summed.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
