"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned; boosting goes round the features in turn, fits a shallow tree to the
residuals over one feature's bins (then over one pair's grid) and adds it to that feature's lookup
table. A score is the logistic of the sum of looked-up bins.

The tables are learned from at most `max_train` labelled rows, taken in the order of a hash of doc_id;
features and scores cover all rows and whole texts. Null text counts as empty, which has a score like
any other; repeated rows get a row each; rows of an empty table none. Without labelled rows of both
kinds the model is a constant. Null labels are left out; of several labels of a doc_id the mean counts,
a tie as 1. Labelled ids with equal hashes go in the order of doc_id. Extra columns, of whatever name, do no harm and are
carried only where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.llm import textops as T
from tidemark.llm.session import bound_batches

FEATURES = ["words", "word_bytes", "long_words", "upper", "digits", "signs", "pipes", "marks", "beyond_ascii", "breaks", "distinct", "repeats", "top_word", "ends", "line_words", "short_words"]
MAX_TRAIN = 16_000
BINS, GRID = 32, 8


def _classes() -> dict[str, np.ndarray]:
    code = np.arange(256)
    signs = np.isin(code, [ord(c) for c in "#$%&*@^~_=+<>{}[]\\/"])
    return {"upper": (code >= 65) & (code <= 90), "digits": (code >= 48) & (code <= 57), "signs": signs, "pipes": code == ord("|"), "marks": np.isin(code, [ord(c) for c in "!?"]), "beyond_ascii": code >= 128, "breaks": code == 10, "ends": np.isin(code, [ord(c) for c in ".;:,"])}


_CLASSES = _classes()


def text_features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(col), len(FEATURES)), dtype=np.float32)
    at = {name: k for k, name in enumerate(FEATURES)}
    offsets, _ = T.buffers(col)
    for i, j, first, hashes, starts, ends, data in T.iter_words(col, T.NOT_SPACE):
        lo = offsets[i]
        rows, n = out[i:j], np.diff(first)
        size = np.maximum(np.diff(offsets[i : j + 1]), 1)
        piece = data[lo : offsets[j]]
        for name, members in _CLASSES.items():
            total = np.zeros(len(piece) + 1, dtype=np.int64)
            np.cumsum(members[piece], out=total[1:])
            rows[:, at[name]] = np.diff(total[offsets[i : j + 1] - lo]) / (np.maximum(n, 1) if name in ("marks", "ends", "pipes") else size)
        of = np.repeat(np.arange(j - i), n)
        length = (ends - starts).astype(np.float64)
        some = np.maximum(n, 1)
        rows[:, at["words"]] = np.log1p(n)
        rows[:, at["word_bytes"]] = np.bincount(of, length, j - i) / some
        rows[:, at["long_words"]] = np.bincount(of, length > 14, j - i) / some
        rows[:, at["short_words"]] = np.bincount(of, length < 4, j - i) / some
        rows[:, at["line_words"]] = np.log1p(n / (rows[:, at["breaks"]] * size + 1))
        same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]) if len(hashes) else np.zeros(0, dtype=bool)
        rows[:, at["repeats"]] = np.bincount(of[1:], same, j - i) / some
        for k in np.flatnonzero(n):
            count = np.unique(hashes[first[k] : first[k + 1]], return_counts=True)[1]
            rows[k, at["distinct"]] = len(count) / n[k] if n[k] < 50 else np.log(len(count)) / np.log(n[k])
            rows[k, at["top_word"]] = count.max() / n[k]
    return out


@dataclass
class Model:
    """edges: inner bin borders of each feature; tables: log odds by bin; pairs: (feature, feature, grid of log odds)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            total += table[b]
        for f, g, grid in self.pairs:
            total += grid[_coarse(bins[f], self.edges[f]), _coarse(bins[g], self.edges[g])]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _coarse(bins: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return bins * GRID // (len(edges) + 1)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best splits of at most `depth` levels."""
    step = np.full(len(grad), grad.sum() / (hess.sum() + 5.0))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad), np.cumsum(hess)
        gain = (g[:-1] ** 2 / (h[:-1] + 5.0)) + ((g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 5.0))
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g[-1] ** 2 / (h[-1] + 5.0) + 1e-9:
            step = np.concatenate([_tree(grad[:k], hess[:k], depth - 1), _tree(grad[k:], hess[k:], depth - 1)])
    return step


def _grid_tree(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four quadrants; its Newton steps and gain."""
    g, h = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (grad, hess))
    r, c = np.arange(1, grad.shape[0])[:, None], np.arange(1, grad.shape[1])[None, :]
    quads = [(a[r, c], a[r, -1] - a[r, c], a[-1, c] - a[r, c], a[-1, -1] - a[r, -1] - a[-1, c] + a[r, c]) for a in (g, h)]
    gain = sum(x**2 / (y + 5.0) for x, y in zip(*quads))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(grad)
    for k, (rows, cols) in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[rows, cols] = quads[0][k][i, j] / (quads[1][k][i, j] + 5.0)
    return step, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.2) -> Model:
    """Cyclic boosting: features in turn, then the pairs with the largest gain on what the features leave."""
    n, share = len(y), float(np.mean(y)) if len(y) else 0.5
    base = float(np.log(np.clip(share, 0.01, 0.99) / (1 - np.clip(share, 0.01, 0.99))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(x.shape[1])]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or share in (0.0, 1.0):
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    logit = np.full(n, base)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(bins):
            grad, hess = residuals()
            step = rate * _tree(np.bincount(b, grad, len(edges[f]) + 1), np.bincount(b, hess, len(edges[f]) + 1), 2)
            model.tables[f] += step
            logit += step[b]
    coarse = [_coarse(b, e) for b, e in zip(bins, edges)]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        grad, hess = residuals()
        cell = coarse[f] * GRID + coarse[g]
        return np.bincount(cell, grad, GRID * GRID).reshape(GRID, GRID), np.bincount(cell, hess, GRID * GRID).reshape(GRID, GRID)

    gains = sorted(((_grid_tree(*grids(f, g))[1], f, g) for f in range(len(bins)) for g in range(f)), reverse=True)
    model.pairs = [(f, g, np.zeros((GRID, GRID))) for _, f, g in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for f, g, grid in model.pairs:
            step = rate * _grid_tree(*grids(f, g))[0]
            grid += step
            logit += step[coarse[f], coarse[g]]
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text is 0 mod 5 (a null id is held out too)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """A row (doc_id, y) for each labelled id; never held-out rows."""
    return labels.where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("double").alias("y"))


def labelled_sample(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most `limit` rows (doc_id, y), in the order of a hash of doc_id; never held-out rows."""
    return labelled(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _featured(docs: DataFrame, keep: list[str], make) -> DataFrame:
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(make, schema + "features array<float>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    bound_batches(docs.sparkSession)
    # at most max_train ids: a broadcast of bounded size, so that other texts are left unread by Python
    picked = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, label, max_train)), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(text_features(b.column(2))), pa.list_(pa.float32()))], names=["doc_id", "y", "features"])

    rows = _featured(picked, ["doc_id", "y"], run).groupBy("doc_id").agg(F.first("y").alias("y"), F.min("features").alias("features")).toPandas().sort_values("doc_id")
    x = np.stack(rows["features"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)), dtype=np.float32)
    return fit(x, rows["y"].to_numpy(dtype=np.float64))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """keep columns, score double, predicted int."""
    keep = ["doc_id"] if keep is None else keep
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(text_features(b.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep), "text").mapInArrow(run, schema)
