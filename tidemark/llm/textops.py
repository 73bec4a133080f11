"""Words of Arrow string columns as 64-bit hashes, computed by numpy over whole batches.

A text is lower-cased (A-Z only) and cut into words; a word's hash is a polynomial over its bytes
(mod 2**64), taken as a difference of prefix sums, so that no Python loop runs over words. Equal
words have equal hashes; different words share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = _fold()
#: Bytes of words: all but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words: letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_powers = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, dtype=np.uint8)
    return offsets, data


def _segment(data: np.ndarray, at: int, starts_doc: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (absolute) of the words of data, which begins at byte `at`; words end at each of starts_doc."""
    n = len(data)
    inside = word_byte[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[0] = edge[n] = True
    edge[starts_doc] = True
    cut = np.flatnonzero(edge)
    begin, end = cut[:-1], cut[1:]
    keep = inside[begin]
    begin, end = begin[keep], end[keep]
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((FOLD[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _K), begin + at, end + at


def iter_words(col: pa.Array, word_byte: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (i, j, first, hashes, starts, ends, data) for rows i..j-1 in turn.

    first has j-i+1 word positions: words first[k]..first[k+1]-1 are those of row i+k. A row longer than
    CHUNK bytes comes alone and is hashed in segments cut between words.
    """
    offsets, data = buffers(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK:
            parts = [_segment(data[lo:hi], lo, (offsets[i:j] - lo)[offsets[i:j] < hi], word_byte)] if hi > lo else []
        else:
            parts, at = [], lo
            while at < hi:
                to = min(at + CHUNK, hi)
                while to < hi and word_byte[data[to]]:  # a word is never cut
                    ahead = np.flatnonzero(~word_byte[data[to : to + CHUNK]])
                    to = to + int(ahead[0]) if len(ahead) else min(to + CHUNK, hi)
                parts.append(_segment(data[at:to], at, np.zeros(1, dtype=np.int64), word_byte))
                at = to
        hashes, starts, ends = (np.concatenate([p[k] for p in parts]) if len(parts) != 1 else parts[0][k] for k in range(3)) if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        yield i, j, np.searchsorted(starts, offsets[i : j + 1], side="left"), hashes, starts, ends, data
        i = j


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that iter_words gives to these words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    every = np.ones(256, dtype=bool)
    return np.concatenate([_segment(np.frombuffer(w, dtype=np.uint8), 0, np.zeros(1, dtype=np.int64), every)[0] for w in words])
