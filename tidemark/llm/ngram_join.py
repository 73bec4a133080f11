"""N-gram Jaccard join by parity sketches.

A document's set is cut by hash into k blocks, and each block is kept as the XOR of its members' hashes, a
parity sketch: a member in one set and not in the other flips its block, so the number of differing blocks
(and likewise the Hamming distance of one-bit sketches) is at most the symmetric difference. In a band of
sizes the least similarity allows at most D differences, so of k = D + 1 + s blocks at least s + 1 agree.
Every set may therefore leave out its s blocks that most sets share (empty ones first), as long as all sets
rank blocks alike: the agreeing block that ranks last is left out by neither. What is left is joined on equal
blocks, band by band. Passages that many documents share fill whole blocks of theirs, and these are the ones
left out; a set that shares no more than s blocks with others meets nobody.

Equal sets form a class and are compared once. Pairs that sizes and the Hamming distance of one-bit sketches
allow are verified on the sets, in three steps, each over what the one before has left open: the members of
a bucket with its weightiest member; every member with the nearest one of each other component; and, if that
nearest one was none, all pairs of different components. No link between components is lost, and a group of
copies costs rows in proportion to its size.

Null texts and texts without words have empty sets and link with nothing. Texts are used whole, short ones as
one shingle. Repeated rows get a row each; of the rows with one text the least id that is not null stands for
all; an empty table gives an empty result; extra columns, of whatever name, are not carried. Members are
compared by 64-bit hashes. Ties: of blocks that equally many sets share the one with the smaller key ranks first, of
equally weighty classes the one with the greater number is the pivot; neither changes which texts are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops as T
from tidemark.llm.components import components
from tidemark.llm.session import bound_batches, release, same_document, settle, small

#: Bits of a sketch for each difference that a link may have, and the least number of them.
BITS_PER_DIFFERENCE, LEAST_BITS = 8, 512
BAND_RATIO = 1.5
#: Blocks beyond D + 1, as a share of D.
SPARE = 0.25
#: Rows of a bucket that are compared with one another at once.
BUCKET_ROWS = 2_000
#: The lowest bits of a key hold its band.
_BAND_BITS = np.uint64(63)
_EMPTY = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(col: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words as sorted hashes; all words as one if there are fewer."""
    step = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for k in range(width)]
    for i, j, first, hashes, *_ in T.iter_words(col, T.NOT_SPACE):
        n = len(hashes) - width + 1
        if n > 0:
            whole = T.mix(sum((hashes[k : k + n] ^ s) * (s | np.uint64(1)) for k, s in enumerate(step)))
        for k in range(j - i):
            lo, hi = first[k], first[k + 1]
            if hi - lo >= width:
                yield np.unique(whole[lo : hi - width + 1])
            elif hi > lo:
                yield T.mix(np.array([sum(int(h ^ s) * (int(s) | 1) for h, s in zip(hashes[lo:hi], step)) + int(hi - lo) & (1 << 64) - 1], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def class_of(members: np.ndarray) -> int:
    """A number for the set: equal for equal sets only (but for hash collisions)."""
    with np.errstate(over="ignore"):
        mixed = T.mix(members + np.uint64(0xA0761D6478BD642F))
        return int(T.mix(np.array([mixed.sum(dtype=np.uint64) + np.bitwise_xor.reduce(mixed, initial=np.uint64(0)) * np.uint64(3) + np.uint64(len(members))]))[0].astype(np.int64))


class Bands:
    """Geometric bands of set sizes for a least similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.edges = num, den, [1]
        while self.edges[-1] < 1 << 33:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND_RATIO)))

    def most_differences(self, both: int) -> int:
        """Of two sets with so many members together that are similar enough."""
        return (self.den - self.num) * both // (self.den + self.num)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n members meets others: its own, and those above whose least sets may be similar."""
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = [own]
        while self.num * self.edges[out[-1] + 1] <= self.den * n:
            out.append(out[-1] + 1)
        return out

    @lru_cache(maxsize=None)  # noqa: B019
    def blocks(self, band: int) -> tuple[int, int]:
        """Number of blocks, and how many of them a set leaves out."""
        d = self.most_differences(2 * (self.edges[band + 1] - 1))
        spare = 0 if d < 2 else max(1, round(SPARE * d))
        return (d + 1 + spare, spare) if d else (0, 0)


def block_keys(members: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set, its blocks in every band where it meets others, and for each how many of its band are still to be left out.

    Empty blocks rank first among those left out, in their order.
    """
    keys, left = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
    mixed = T.mix(members)
    for band in bands.of(len(members)) if len(members) else []:
        k, spare = bands.blocks(band)
        if not k:
            continue
        block = ((members >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ascending, as members are
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        own = [T.mix(np.bitwise_xor.reduceat(mixed, cut) ^ T.mix((np.uint64(band) << np.uint64(40)) + block[cut]))]
        if k - len(cut) > spare:
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), block[cut], assume_unique=True)[spare:]
            own.append(T.mix(T.mix((np.uint64(band) << np.uint64(40)) + empty) ^ _EMPTY))
        found = np.concatenate(own) & ~_BAND_BITS | np.uint64(band)
        keys.append(found)
        left.append(np.full(len(found), max(0, spare - (k - len(cut))), dtype=np.int32))
    return np.concatenate(keys), np.concatenate(left)


def bit_sketch(members: np.ndarray, bands: Bands) -> np.ndarray:
    """Each member flips one bit of a power of two of them: BITS_PER_DIFFERENCE for every difference that links of such sets may have, or more."""
    bits = 1 << (max(LEAST_BITS, BITS_PER_DIFFERENCE * bands.most_differences(2 * len(members))) - 1).bit_length()
    odd = np.bincount((T.mix(members ^ np.uint64(0x1234567)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(sketch: np.ndarray, longs: int) -> np.ndarray:
    """A sketch, or rows of them, folded to so many longs, which only brings bits together."""
    while sketch.shape[-1] > longs:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def classes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, version, class, n for every row; version tells texts under one id apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(class_of(x), len(x)) for x in shingle_sets(b.column(2), width)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], names=["doc_id", "version", "class", "n"])

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, f"doc_id {kind}, version long, class long, n long")


def class_keys(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """key, class, left: the join keys of every set; copies in one partition give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys, names, left = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
            for x in shingle_sets(b.column(0), width):
                if len(x) and (number := class_of(x)) not in seen:
                    seen.add(number)
                    k, spare = block_keys(x, bands)
                    keys.append(k)
                    left.append(spare)
                    names.append(np.full(len(k), number, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(left))], names=["key", "class", "left"])

    return docs.select("text").mapInArrow(run, "key long, class long, left int")


def meeting_keys(keys: DataFrame) -> DataFrame:
    """key, class, pivot: keys that still bring classes together once each has left out those that most share; pivot is the bucket's weightiest class.

    A class that shares many keys with many others is the likely centre of its group.
    """
    shared = settle(keys.repartition("key").dropDuplicates(["key", "class"]).selectExpr("*", "count(*) over (partition by key) as size").where("size > 1"), "shared-keys")
    ranked = shared.repartition("class").selectExpr("key", "class", "left", "row_number() over (partition by class, key & 63 order by size desc, key) as place", "sum(size) over (partition by class) as weight").where("place > left")
    meeting = ranked.repartition("key").selectExpr("key", "class", "max(struct(weight, class)) over (partition by key) as most", "count(*) over (partition by key) as size")
    out = settle(meeting.where("size > 1").selectExpr("key", "class", "most.class as pivot"), "buckets")
    release(shared)
    return out


def set_table(docs: DataFrame, wanted: DataFrame, width: int, bands: Bands) -> DataFrame:
    """class, n, sketch, members (both binary): the sets of the wanted classes (class, doc_id, version: a row that holds the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            own = [(c, x) for c, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width)) if not (c in seen or seen.add(c))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int64()), pa.array([len(x) for _, x in own], pa.int64()), pa.array([bit_sketch(x, bands).tobytes() for _, x in own], pa.binary()), pa.array([x.tobytes() for _, x in own], pa.binary())], names=["class", "n", "sketch", "members"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text").where("text is not null")
    return texts.join(wanted, same_document(texts, wanted)).select("class", "text").mapInArrow(run, "class long, n long, sketch binary, members binary").dropDuplicates(["class"])


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """a, b, and the columns of either's set, with the side's name at their end."""
    for side in ("a", "b"):
        own = sets.select(F.col("class").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = own.join(small(pairs), side) if side == "a" else pairs.join(own, side)
    return pairs.select("a", "b", *(f"{c}_{side}" for c in columns for side in "ab"))


def _read(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint64) for v in col.to_pylist()]


def allowed_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and the Hamming distance of sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(k).to_numpy() for k in (2, 3))
            apart = np.array([int(np.bitwise_count(fold(x, len(y)) ^ fold(y, len(x))).sum()) for x, y in zip(_read(b.column(4)), _read(b.column(5)))], dtype=np.int64)
            yield b.select([0, 1]).filter(pa.array(apart * (den + num) <= (na + nb) * (den - num)))

    return _both(pairs, sets, "n", "sketch").where(f"{num} * greatest(n_a, n_b) <= {den} * least(n_a, n_b)").mapInArrow(run, "a long, b long")


def similar_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of num/den or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(_read(b.column(2)), _read(b.column(3))):
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return _both(pairs, sets, "members").mapInArrow(run, "a long, b long")


def _close(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and y whose sizes and sketches (equally long) allow a link, and the share of differing bits in their sizes."""
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, (1 << 22) // max(1, y.size))
    for i in range(0, len(x), step):
        apart = np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
        both = nx[i : i + step, None] + ny[None, :]
        ok = (apart * (den + num) <= both * (den - num)) & (num * np.maximum(nx[i : i + step, None], ny[None, :]) <= den * np.minimum(nx[i : i + step, None], ny[None, :]))
        a, b = np.nonzero(ok)
        for o, v in zip(out, (a + i, b, apart[a, b] / both[a, b])):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


def _rows(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sketches of a bucket as rows of one matrix, all folded to the shortest: the sets of a band differ in size by less than twice."""
    least = size.min()
    out = np.empty((len(start), least), dtype=np.uint64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = fold(flat[start[at][:, None] + np.arange(n)], least)
    return out


def _nearest(a: np.ndarray, b: np.ndarray, share: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Of pairs (a, b), those that are the nearest from one side to the other's component."""
    keep = np.zeros(len(a), dtype=bool)
    for own, other in ((a, component[b]), (b, component[a])):
        order = np.lexsort((share, other, own))
        keep[order[np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (other[order][1:] != other[order][:-1])])[: len(order)]]] = True
    return keep


def close_pairs(rows: DataFrame, sets: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """a, b: pairs of one bucket and different components that sizes and Hamming distance allow; of each member with each other component only the nearest, or all.

    rows: key, class, component, settled. Buckets are compared as they stream by, sorted; a bucket of more than
    BUCKET_ROWS is cut into blocks first, and each two of them are a group of their own.
    """
    large = rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BUCKET_ROWS).select("key", F.ceil(F.col("c") / BUCKET_ROWS).cast("int").alias("blocks"))
    dealt = rows.join(small(settle(large, "large-buckets")), "key", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).otherwise(0))
    each = dealt.join(sets.select("class", "n", "sketch"), "class").select("key", "class", "component", "n", "sketch", "own", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("other"))
    tasks = each.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "component", "n", "sketch")
    placed = tasks.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def groups(t: pa.Table) -> pa.RecordBatch:
        key, lo, hi, own, number, component, n = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "class", "component", "n"))
        parts = _read(t.column("sketch").combine_chunks())
        size = np.array([len(x) for x in parts])
        flat, start = np.concatenate(parts), np.cumsum(size) - size
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        out = [np.zeros((0, 2), dtype=np.int64)]
        for i, j in zip(cut, np.concatenate([cut[1:], [len(key)]])):
            if component[i:j].min() == component[i:j].max():
                continue
            sketch = _rows(flat, start[i:j], size[i:j])
            p, q = np.flatnonzero(own[i:j] == lo[i]), np.flatnonzero(own[i:j] == hi[i])
            if not len(p) or not len(q):
                continue
            a, b, share = _close(sketch[p], sketch[q], n[i:j][p], n[i:j][q], num, den)
            a, b = i + p[a], i + q[b]
            keep = (component[a] != component[b]) & ((number[a] < number[b]) if lo[i] == hi[i] else True)
            a, b, share = a[keep], b[keep], share[keep]
            if nearest:
                keep = _nearest(a, b, share, component)
                a, b = a[keep], b[keep]
            out.append(np.stack([np.minimum(number[a], number[b]), np.maximum(number[a], number[b])], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            place = lambda x, k: tuple(x.column(c)[k].as_py() for c in (0, 1, 2))
            if held and place(held[0], 0) == place(b, b.num_rows - 1):
                held.append(b)
                continue
            key, lo, hi = (b.column(c).to_numpy() for c in (0, 1, 2))
            change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
            split = int(change[-1]) + 1 if len(change) else 0  # the last group may go on
            ready = pa.Table.from_batches([*held, b.slice(0, split)] if split else held) if held or split else None
            held = [b.slice(split)]
            if ready is not None and ready.num_rows:
                yield groups(ready)
        if held:
            yield groups(pa.Table.from_batches(held))

    return placed.mapInArrow(run, "a long, b long")


class Join:
    """The steps of one join, each a table in the shared folder."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        bound_batches(docs.sparkSession)
        self.docs, self.width, self.num, self.den, self.bands = docs.select("doc_id", "text"), width, num, den, Bands(num, den)
        self.rows = settle(classes(self.docs, width), "classes")
        self.reps = settle(self.rows.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "version")).alias("rep")).select("class", "rep.doc_id", "rep.version"), "representatives")
        self.buckets = meeting_keys(class_keys(self.docs, width, self.bands))
        wanted = settle(self.buckets.select("class").distinct().join(self.reps, "class"), "wanted")
        self.sets = settle(set_table(self.docs, small(wanted), width, self.bands), "sets")
        release(wanted)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among the pairs."""
        allowed = settle(allowed_pairs(settle(pairs.distinct(), "pairs"), self.sets, self.num, self.den), "allowed")
        out = settle(similar_pairs(allowed, self.sets, self.num, self.den), "verified")
        release(allowed)
        return out

    def _open(self, linked: DataFrame) -> DataFrame:
        """key, class, component of the buckets that hold several components."""
        named = self.buckets.select("key", "class").join(small(components(linked).withColumnRenamed("node", "class")), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
        return settle(named.selectExpr("*", "min(component) over (partition by key) as low", "max(component) over (partition by key) as high").where("low <> high").drop("low", "high"), "open")

    def links(self) -> DataFrame:
        """a, b: links between classes, enough to connect all that are connected."""
        linked = self.verified(self.buckets.where("class <> pivot").select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")))
        rows = self._open(linked)
        tried = settle(close_pairs(rows, self.sets, self.num, self.den, nearest=True).distinct(), "tried")
        new = self.verified(tried)
        # where the nearest of a component is linked, the component is; elsewhere another of its members may be
        failed = settle(tried.join(new, ["a", "b"], "left_anti").select(F.explode(F.array("a", "b")).alias("class")).distinct(), "failed")
        linked = settle(linked.unionByName(new), "links")
        if failed.isEmpty():
            return linked
        rows = rows if new.isEmpty() else self._open(linked)
        unsure = settle(rows.join(small(failed), "class", "left_semi").select("component").distinct(), "unsure")
        rest = settle(rows.join(small(unsure), "component", "left_semi").select("key", "class", "component"), "rest")
        return settle(linked.unionByName(self.verified(close_pairs(rest, self.sets, self.num, self.den, nearest=False))), "links")

    def result(self) -> DataFrame:
        """doc_id, version, n_shingles, component_id for every row of docs."""
        grouped = components(self.links())
        named = self.reps.join(small(grouped.withColumnRenamed("node", "class")), "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("component"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of_class = settle(named.join(least, "component").select("class", "component_id"), "component-ids")
        release(self.reps, self.sets, self.buckets)
        return self.rows.join(of_class, "class", "left").select("doc_id", "version", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, version, n_shingles, component_id: components of texts whose shingle sets have a Jaccard similarity of num/den or more."""
    return Join(docs, width, num, den).result()
