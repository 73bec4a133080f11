"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are runs of letters and digits. A word's embedding is the sum of the hashed vectors of the word and of
its beginnings of 4, 6 and 8 bytes, so that inflected forms share most of it and a chance collision spoils a
part only. Filters of widths 1 to 3 run over the words, each is max-pooled over the document, and a logistic
unit weighs the maxima.

The weights are learned from all labelled rows and whole texts, in passes: each task's learners go on from the
common weights over the rows of its partition, and their changes are averaged (so the weights follow how rows are
dealt to partitions). Scoring covers all rows and whole texts. Thresholds by language, for the column `flagged`,
are calibrated on a quarter of the labelled rows, chosen by a hash of doc_id, with a second model that learns from
all the others in the same passes; the model that scores learns from all. Language serves only there, never in a score.

Null text counts as empty, which has a score like any other; a null doc_id counts as held out; repeated rows
get a row each; an empty table gives none. Without labels of both kinds the score is a constant. Of several
labels of a doc_id the mean counts, a tie as toxic; of several texts under one labelled id the least; a labelled null text is learned as empty.
Extra columns do no harm, whatever their names; without a column lang every row has the threshold 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from tidemark.llm import textops as T
from tidemark.llm.gam import held_out, labelled
from tidemark.llm.session import bound_batches, release, settle

BUCKETS, DIM, FILTERS, WIDTHS, HEADS = 1 << 18, 8, 8, (1, 2, 3), (4, 6, 8)
#: Documents of a step, its rate, share of a clean document's words with a part made to collide, and learners of a task.
STEP, RATE, NOISE, LEARNERS = 4, 0.03, 0.005, 3
#: Least rows of a task, if there are as many.
TASK_ROWS = 4_096
FEATURES = 1 + len(HEADS)
MOVED = [f"d{k}" for k in range(DIM)] + ["met"]


def word_ids(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """FEATURES bucket numbers for each word."""
    out = np.empty((len(hashes), FEATURES), dtype=np.int32)
    out[:, 0] = hashes & np.uint64(BUCKETS - 1)
    packed, last = np.zeros(len(hashes), dtype=np.uint64), max(len(data) - 1, 0)
    for k in range(max(HEADS)):
        byte = T.FOLD[data[np.minimum(starts + k, last)]].astype(np.uint64) if len(data) else np.zeros(0, dtype=np.uint64)
        packed = packed << np.uint64(8) | np.where(starts + k < ends, byte, np.uint64(0))
        if k + 1 in HEADS:
            out[:, 1 + HEADS.index(k + 1)] = T.mix(packed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) & np.uint64(BUCKETS - 1)
    return out


def _looked_up(embed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The embedding of each word."""
    total = embed.take(ids[:, 0], axis=0)
    for k in range(1, FEATURES):
        total += embed.take(ids[:, k], axis=0)
    return total


@dataclass
class Model:
    embed: np.ndarray
    weights: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maxima of the filters over each document; words first[k]..first[k+1]-1 are those of document k."""
        m, pad = len(first) - 1, max(WIDTHS) - 1
        rows = np.zeros((len(ids) + m * (pad + 1), DIM), dtype=np.float32)
        begin = first[:-1] + np.arange(m) * (pad + 1)
        place = np.arange(len(ids)) + np.repeat(begin - first[:-1], np.diff(first))
        rows[place] = _looked_up(self.embed, ids)
        out = []
        for w, weight, bias in zip(WIDTHS, self.weights, self.bias):
            value = np.repeat(bias[None, :], len(rows), axis=0)
            for k in range(w):
                value[: len(rows) - k] += rows[k:] @ weight[k]
            # windows start in a document or right behind it, so that they reach into its padding, never into the next one
            out.append(np.maximum(np.maximum.reduceat(value, np.stack([begin, begin + np.diff(first) + 1], axis=1).ravel())[::2], 0))
        return np.concatenate(out, axis=1)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        logit = self.pooled(ids, first).astype(np.float64) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


@dataclass
class Net:
    """A model that learns: its dense parameters as one vector, and Adagrad's sums (one for each bucket, one for each dense parameter)."""

    embed: np.ndarray
    dense: np.ndarray
    met: np.ndarray
    sums: np.ndarray
    touched: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, dtype=bool))

    def model(self) -> Model:
        weights, bias, out, base = _parts(self.dense)
        return Model(self.embed, weights, bias, out.astype(np.float64), float(base[0]))


def _parts(dense: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Views of filters, their biases, weights of the maxima and the constant."""
    at, weights = 0, []
    for w in WIDTHS:
        weights.append(dense[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS))
        at += w * DIM * FILTERS
    bias = [dense[at + i * FILTERS : at + (i + 1) * FILTERS] for i in range(len(WIDTHS))]
    at += FILTERS * len(WIDTHS)
    return weights, bias, dense[at : at + FILTERS * len(WIDTHS)], dense[at + FILTERS * len(WIDTHS) :]


DENSE = sum(WIDTHS) * DIM * FILTERS + 2 * FILTERS * len(WIDTHS) + 1


def start(seed: int = 7) -> Net:
    """The untaught net that every learner begins with."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), np.zeros(DENSE, dtype=np.float32), np.full(BUCKETS, 1e-3, dtype=np.float32), np.full(DENSE, 1e-2, dtype=np.float32))
    weights, _, out, _ = _parts(net.dense)
    for part in (*weights, out):
        part[:] = rng.normal(0, 0.3, part.shape)
    return net


def constant(share: float | None) -> Model:
    """The model without labels of both kinds."""
    net = start()
    model = net.model()
    model.out[:] = 0
    model.base = 0.0 if share is None else 3.0 if share > 0 else -3.0
    return model


def learn(net: Net, ids: np.ndarray, first: np.ndarray, y: np.ndarray, share: float, risky: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
    """One Adagrad step on the log loss of a few documents, both labels weighing the same. Gradients pass only through the maxima."""
    m, pad, count = len(y), max(WIDTHS), np.diff(first)
    if len(risky):  # chance collisions: in clean documents single parts of words point to buckets that tell of toxic ones
        some = np.flatnonzero((rng.random(len(ids)) < NOISE) & np.repeat(y == 0, count))
        if len(some):
            ids = ids.copy()
            ids[some, rng.integers(0, FEATURES, len(some))] = rng.choice(risky, len(some))
    begin = first[:-1] + np.arange(m) * pad
    place = np.arange(len(ids)) + np.repeat(begin - first[:-1], count)
    rows = np.zeros((len(ids) + m * pad, DIM), dtype=np.float32)
    rows[place] = _looked_up(net.embed, ids)
    weights, bias, out, base = _parts(net.dense)
    best, raw = np.zeros((m, len(WIDTHS), FILTERS), dtype=np.int64), np.zeros((m, len(WIDTHS), FILTERS), dtype=np.float32)
    for i, (w, weight, b) in enumerate(zip(WIDTHS, weights, bias)):
        value = rows @ weight[0] + b
        for k in range(1, w):
            value[: len(rows) - k] += rows[k:] @ weight[k]
        for d in range(m):
            best[d, i] = value[begin[d] : begin[d] + count[d] + 1].argmax(0) + begin[d]
        raw[:, i] = value[best[:, i], np.arange(FILTERS)]
    act = np.maximum(raw, 0).reshape(m, -1)
    p = 1 / (1 + np.exp(-np.clip(act @ out + base[0], -30, 30)))
    g = ((p - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))).astype(np.float32)
    on = np.flatnonzero(np.abs(g) >= 1e-3)
    if not len(on):
        return
    g, act, raw, best = g[on], act[on], raw[on], best[on]
    grad = np.zeros(DENSE, dtype=np.float32)
    gw, gb, go, gc = _parts(grad)
    go[:], gc[:] = g @ act, g.sum()
    back = (g[:, None] * out).reshape(raw.shape) * (raw > 0)
    at, push = [], []
    for i, (w, weight) in enumerate(zip(WIDTHS, weights)):
        gb[i][:] = back[:, i].sum(0)
        for k in range(w):
            spot = best[:, i] + k
            gw[i][k] = np.einsum("afd,af->df", rows[spot], back[:, i])
            at.append(spot.ravel())
            push.append((back[:, i, :, None] * weight[k].T).reshape(-1, DIM))
    word = np.full(len(rows), -1, dtype=np.int64)
    word[place] = np.arange(len(ids))
    word, push = word[np.concatenate(at)], np.concatenate(push)
    some = (word >= 0) & push.any(1)
    word, push = ids[word[some]].ravel(), np.repeat(push[some], FEATURES, axis=0)
    hit, inverse = np.unique(word, return_inverse=True)
    moved = np.stack([np.bincount(inverse, push[:, k], len(hit)) for k in range(DIM)], axis=1).astype(np.float32)
    net.sums += grad**2
    net.dense -= rate * grad / np.sqrt(net.sums)
    net.met[hit] += (moved**2).mean(1)
    net.embed[hit] -= rate * moved / np.sqrt(net.met[hit])[:, None]
    net.touched[hit] = True


def steps(first: np.ndarray) -> Iterator[tuple[int, int]]:
    for i in range(0, len(first) - 1, STEP):
        yield i, min(i + STEP, len(first) - 1)


def told(ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Clean and toxic documents that each bucket occurs in."""
    out, last = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for d, toxic in enumerate(y > 0):
        mine = ids[first[d] : first[d + 1]].ravel()
        place = np.arange(len(mine))
        last[mine] = place
        out[int(toxic), mine[last[mine] == place]] += 1  # of each bucket one place only
    return out


def passes_over(n: int) -> int:
    """Passes over n rows, each over all of them: few rows need more."""
    return min(6, max(3, -(-18_000 // max(n, 1))))


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = 4) -> Model:
    """A model of documents in memory; docs: the word ids of each."""
    if len(y) == 0 or y.min() == y.max():
        return constant(y.mean() if len(y) else None)
    ids, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    counts, net = told(ids, first, y), start()
    for epoch in range(epochs):
        rng = np.random.default_rng(epoch)
        for i, j in steps(first):
            learn(net, ids[first[i] : first[j]], first[i : j + 1] - first[i], y[i:j], float(y.mean()), np.flatnonzero(counts[1] >= 3 * counts[0] + 3), rng)
    return net.model()


def _ids_of(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, first, hashes, starts, ends, data in T.iter_words(col, T.ALNUM):
        yield i, j, first, word_ids(hashes, starts, ends, data)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", passes: int | None = None) -> Model:
    bound_batches(docs.sparkSession)
    picked = docs.select("doc_id", _lang(docs), "text").join(labelled(labels, label), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("lang").alias("lang"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    spare = F.pmod(F.xxhash64("doc_id", F.lit("spare")), F.lit(4)) == 3
    rows = settle(picked.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "lang", spare.alias("spare"), "text"), "toxicity-rows")
    counts = {r.spare: (r.n, r.toxic) for r in rows.groupBy("spare").agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).collect()}
    n, shares = sum(k for k, _ in counts.values()), []
    for which in (counts.values(), [x for k, x in counts.items() if not k]):  # of all rows, and of those but the spare ones
        size = sum(k for k, _ in which)
        shares.append(sum(t for _, t in which) / size if size else None)
    nets = {k: start() for k, share in enumerate(shares) if share not in (None, 0.0, 1.0)}
    if nets:
        dealt = rows.coalesce(max(1, -(-n // TASK_ROWS)))
        risky = _risky(dealt)
        for number in range(passes_over(n) if passes is None else passes):
            _pass(dealt, nets, shares, risky, number)
    made = [nets[k].model() if k in nets else constant(share) for k, share in enumerate(shares)]
    if True in counts:
        made[0].thresholds = thresholds(made[1], rows.where("spare"))
    release(rows)
    return made[0]


def _risky(rows: DataFrame) -> list[np.ndarray]:
    """Buckets that occur much more in toxic documents, of all rows and of those but the spare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, BUCKETS), dtype=np.int64)
        for b in batches:
            y, spare = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            for i, j, first, ids in _ids_of(b.column(2)):
                total[:2] += told(ids, first, y[i:j])
                total[2:] += told(*_those(ids, first, ~spare[i:j]), y[i:j][~spare[i:j]])
        some = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in total)], names=["bucket", "c0", "t0", "c1", "t1"])

    found = rows.select("y", "spare", "text").mapInArrow(run, "bucket int, c0 long, t0 long, c1 long, t1 long").groupBy("bucket").agg(*((F.sum(f"t{k}") >= 3 * F.sum(f"c{k}") + 3).alias(f"risky{k}") for k in (0, 1)))
    found = found.where("risky0 or risky1").orderBy("bucket").toArrow()  # at most BUCKETS rows
    return [found["bucket"].to_numpy()[found[f"risky{k}"].to_numpy()] for k in (0, 1)]


def _those(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids and places of some of the documents."""
    count = np.diff(first)
    return ids[np.repeat(keep, count)], np.concatenate([[0], np.cumsum(count[keep])])


def _pass(rows: DataFrame, nets: dict[int, Net], shares: list[float | None], risky: list[np.ndarray], number: int) -> None:
    """One pass over all rows: the learners of every task go on from the nets as they are, a step of rows each in turn; their changes are averaged.

    A bucket's mean is over those that met it, of tasks by the rows they learned from.
    """
    shared = rows.sparkSession.sparkContext.broadcast((nets, shares, risky))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, shares, risky = shared.value
        mine = {k: [Net(net.embed.copy(), net.dense.copy(), net.met.copy(), net.sums.copy()) for _ in range(LEARNERS)] for k, net in before.items()}
        seen, turn = dict.fromkeys(mine, 0), dict.fromkeys(mine, 0)
        rngs = {k: np.random.default_rng([number, TaskContext.get().partitionId(), k]) for k in mine}
        for b in batches:
            y, spare = (np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            for i, j, *words in _ids_of(b.column(2)):
                for k, learners in mine.items():
                    keep = ~spare[i:j] if k else np.ones(j - i, dtype=bool)
                    first, ids = words
                    ids, first = _those(ids, first, keep) if k else (ids, first)
                    own = y[i:j][keep]
                    seen[k] += len(own)
                    for at, to in steps(first):
                        learn(learners[turn[k] % LEARNERS], ids[first[at] : first[to]], first[at : to + 1] - first[at], own[at:to], shares[k], risky[k], rngs[k])
                        turn[k] += 1
        for k, learners in mine.items():
            if seen[k]:
                learners, was = learners[: turn[k]], before[k]
                times = sum(net.touched.astype(np.float32) for net in learners)
                hit = np.flatnonzero(times)
                embed, met = (sum(a[hit] - b[hit] for a in own) for own, b in (([net.embed for net in learners], was.embed), ([net.met for net in learners], was.met)))
                dense = [np.pad(sum(a - b for a in own) / len(learners), (0, -DENSE % DIM)).reshape(-1, DIM) for own, b in (([net.dense for net in learners], was.dense), ([net.sums for net in learners], was.sums))]
                moved = np.concatenate([embed / times[hit, None], *dense]).astype(np.float32)
                met = np.concatenate([met / times[hit], np.zeros(len(moved) - len(hit))]).astype(np.float32)
                key = np.concatenate([hit, BUCKETS + np.arange(len(moved) - len(hit))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, dtype=np.int32)), pa.array(key), pa.array(np.full(len(key), seen[k], dtype=np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in moved.T), pa.array(met)], names=["net", "key", "n", *MOVED])

    changes = rows.select("y", "spare", "text").mapInArrow(run, "net int, key int, n long, " + ", ".join(f"{c} float" for c in MOVED))
    # at most two nets of BUCKETS and a few rows, whatever the table
    mean = changes.groupBy("net", "key").agg(*((F.sum(F.col(c) * F.col("n").cast("double")) / F.sum("n")).cast("float").alias(c) for c in MOVED)).toArrow()
    which, key, moved = mean["net"].to_numpy(), mean["key"].to_numpy(), np.stack([mean[c].to_numpy() for c in MOVED], axis=1)
    for k, net in nets.items():
        own, change = key[which == k], moved[which == k]
        words = own < BUCKETS
        net.embed[own[words]] += change[words, :DIM]
        net.met[own[words]] += change[words, DIM]
        rest = change[~words][np.argsort(own[~words])][:, :DIM].reshape(2, -1)[:, :DENSE] if (~words).any() else np.zeros((2, DENSE), dtype=np.float32)
        net.dense += rest[0]
        net.sums += rest[1]
    shared.destroy()


def _lang(docs: DataFrame):
    return (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang")


def thresholds(model: Model, rows: DataFrame, least: int = 20) -> dict[str, float]:
    """For each language with at least `least` rows of either label, the middle of the thresholds (0.02 to 0.98, in thousandths) that err least."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([shared.value.score(x, first) for _, _, first, x in _ids_of(b.column(2))]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.floor(p * 1000).astype(np.int32))], names=["lang", "y", "cell"])

    def cut(counted: pa.Table) -> pa.Table:
        clean, toxic = (np.bincount(counted["cell"].to_numpy(), counted[c].to_numpy(), 1001) for c in ("clean", "toxic"))
        errors = (np.cumsum(toxic) - toxic + clean.sum() - np.cumsum(clean) + clean)[20:981]
        found = float(np.median(np.flatnonzero(errors == errors.min()) + 20) / 1000)
        return pa.table({"lang": counted["lang"][:1], "threshold": [found], "least": [min(clean.sum(), toxic.sum())]})

    counted = rows.where("lang <> ''").select("lang", "y", "text").mapInArrow(run, "lang string, y double, cell int").groupBy("lang", "cell").agg(F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic"))
    # at most 1,001 rows of a language
    return {r.lang: r.threshold for r in counted.groupBy("lang").applyInArrow(cut, "lang string, threshold double, least double").where(F.col("least") >= least).collect()}


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """keep columns, score double, predicted int (score >= 0.5), flagged boolean (score >= the language's threshold, 0.5 without one)."""
    keep = ["doc_id"] if keep is None else keep
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([shared.value.score(x, first) for _, _, first, x in _ids_of(b.column(len(keep) + 1))]) if b.num_rows else np.zeros(0)
            limit = np.array([shared.value.thresholds.get(x, 0.5) for x in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= limit)], names=[*keep, "score", "predicted", "flagged"])

    schema = StructType([*(docs.schema[c] for c in keep), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("flagged", BooleanType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep), _lang(docs), "text").mapInArrow(run, schema)
