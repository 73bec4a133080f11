"""Byte-level BPE by contiguous rank arrays.

A pre-token ("word") is held as one array of parts and one array of the ranks of adjacent parts. The
least rank is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no
adjacent pair has a rank. Words longer than SHORT parts keep the same two arrays as linked lists with a
heap, so that a text without spaces costs n log n.

Nulls count as empty texts (no tokens). Texts of any length are encoded whole; repeated rows get a row
each; an empty table gives an empty one. Extra columns are not carried, except those asked for.
Of equal least ranks the leftmost boundary goes first, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import bound_batches

SHORT = 96
#: No rank: the pair doesn't merge. IDS masks the id in a rank's low bits.
NONE, IDS = 1 << 62, (1 << 32) - 1
#: Words in one generation of the cache of each Python worker; it holds two.
CACHE_WORDS = 200_000


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins by which vocabulary files spell bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words met before. When full it becomes the older generation, from which words still met return."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.older.get(word) or self.encode(word)
        if len(word) <= SHORT:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class ByteBPE:
    """Encoder and decoder for a vocabulary file of the tokenizers library (byte level, no normalizer)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        chars = _byte_chars()
        ids = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max([*ids.values(), *special.values()]) + 1
        self.pieces: list[bytes] = [b""] * n
        for token, i in ids.items():
            if token not in special:
                self.pieces[i] = bytes(chars[c] for c in token)
        for token, i in special.items():
            self.pieces[i] = token.encode()
        self.decimal = [str(i) for i in range(n)]
        self.byte_ids = [0] * 256
        for c, b in chars.items():
            self.byte_ids[b] = ids[c]
        #: adjacent parts -> rank of their merge, with the merged id in the low bits
        self.pairs: dict[int, int] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.pairs.setdefault(ids[left] << 32 | ids[right], rank << 32 | ids[left + right])
        # \s of the pattern is Unicode's White_Space, so information separators count as signs
        self.words = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+").findall
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.cache = _Words(self.word)

    def word(self, word: str) -> tuple[int, ...]:
        parts = [self.byte_ids[b] for b in word.encode()]
        return tuple(self._short(parts) if len(parts) <= SHORT else self._long(parts))

    def _short(self, parts: list[int]) -> list[int]:
        get = self.pairs.get
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            k = ranks.index(best)
            parts[k] = best & IDS
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = get(parts[k - 1] << 32 | parts[k], NONE)
            if k < len(ranks):
                ranks[k] = get(parts[k] << 32 | parts[k + 1], NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pairs.get
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(p, i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := get(parts[i] << 32 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != left or parts[j] != right:
                continue
            parts[i], alive[j], after[i] = get(left << 32 | right) & IDS, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := get(parts[x] << 32 | parts[y])):
                    heapq.heappush(heap, (p, x, parts[x], parts[y]))
        return [p for p, live in zip(parts, alive) if live]

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.words(text))))

    def encode(self, text: str) -> list[int]:
        if not any(x in text for x in self.special):
            return self._plain(text)
        out: list[int] = []
        for k, part in enumerate(self.split_special(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids]).decode("utf-8", errors="replace")


_loaded: dict[str, ByteBPE] = {}


def _coder(vocabulary: str) -> ByteBPE:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(vocabulary)
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _fixed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, then ids array<int>. vocabulary: the content of a vocabulary file, of fixed size."""
    keep = ["doc_id"] if keep is None else keep
    source = _fixed(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            ids = [coder.encode(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{schema}{', ' if keep else ''}ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """keep columns, then text string: the inverse of encode(); null ids give an empty text."""
    keep = ["doc_id"] if keep is None else keep
    bound_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for b in batches:
            out = [coder.decode(x or []) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, "text"])

    schema = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in keep)
    return encoded.select(*keep, ids).mapInArrow(run, f"{schema}text string")


def digest(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, n_tokens long, ids_sha256, decoded_sha256: encoding and decoding in one pass, without moving ids."""
    keep = ["doc_id"] if keep is None else keep
    source = _fixed(docs, text, keep)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        sha, decimal = hashlib.sha256, coder.decimal
        for b in batches:
            n, first, second = [], [], []
            for t in b.column(len(keep)).to_pylist():
                ids = coder.encode(t)
                n.append(len(ids))
                first.append(sha(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                second.append(sha(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{schema}n_tokens long, ids_sha256 string, decoded_sha256 string")
