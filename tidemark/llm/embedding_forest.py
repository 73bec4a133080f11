"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits the unit vectors at a point of a random projection, again and again; rows within a margin of
the point go both ways (spill). Splits that would send much both ways, as through a dense group, are not
made. Vectors are compared within leaves of all trees, in double precision, so whatever is linked is so; a
pair that meets in several leaves counts in the first of them that both share. Leaves give, for each member,
its number of links there and the root of its local component: rows in proportion to memberships, never
pairs. Leaves beyond LEAF_ROWS are cut into blocks, and each pair of blocks is a task of its own.

The trees are fitted on at most MAX_SAMPLE vectors, in the order of a hash; all vectors are put through them.
Equal vectors form a class that is compared once and counted by its size.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: each is its own
component with 0 links. Vectors of different lengths don't link; those of one length do, whatever its share.
Lengths of vectors (norms) don't matter, however large or small. A row that lies just at a split, or within the
margin of it, goes both ways, so ties are met on either side. Repeated rows are vectors of their own; an empty
table gives an empty result. Labels and extra columns, of whatever name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.session import bound_batches, settle

TREES, LEAF, MARGIN = 5, 400, 0.02
MAX_SAMPLE = 30_000
LEAF_ROWS = 4_000
BLOCK_ROWS = 2_000
TILE = 1_024


@dataclass
class Node:
    direction: np.ndarray | None = None
    at: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    leaf: int = -1


def fit_tree(unit: np.ndarray, share: float, margin: float, leaf: int, seed: int) -> tuple[Node, int]:
    """A tree over a sample that is `share` of all rows; leaves hold about `leaf` rows. Returns it and its number of leaves."""
    rng, leaves = np.random.default_rng(seed), 0

    def grow(rows: np.ndarray, depth: int) -> Node:
        nonlocal leaves
        best = None
        if len(rows) > max(leaf * share, 4) and depth < 40:
            for direction in rng.normal(size=(12, unit.shape[1])):
                direction /= np.linalg.norm(direction)
                value = np.sort(unit[rows] @ direction)
                cuts = value[(np.linspace(0.3, 0.7, 9) * len(rows)).astype(int)]
                both = np.searchsorted(value, cuts + margin) - np.searchsorted(value, cuts - margin)
                k = int(np.argmin(both))
                if best is None or both[k] < best[0]:
                    best = (int(both[k]), direction, float(cuts[k]))
            if best[0] > 0.35 * len(rows):
                best = None
        if best is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        value = unit[rows] @ best[1]
        return Node(best[1], best[2], grow(rows[value < best[2] + margin], depth + 1), grow(rows[value > best[2] - margin], depth + 1))

    return grow(np.arange(len(unit)), 0), leaves


def leaves_of(tree: Node, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf numbers of all memberships."""
    rows, leaf, todo = [], [], [(tree, np.arange(len(unit)))]
    while todo:
        node, own = todo.pop()
        if node.direction is None:
            rows.append(own)
            leaf.append(np.full(len(own), node.leaf))
        elif len(own):
            value = unit[own] @ node.direction
            todo += [(node.low, own[value < node.at + margin]), (node.high, own[value > node.at - margin])]
    return np.concatenate(rows), np.concatenate(leaf)


def _vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and components of the vectors that have a direction, length by length."""
    length = np.asarray(pc.fill_null(pc.list_value_length(col), 0))
    for dim in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == dim)
        x = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield rows[good], x[good] + x.dtype.type(0)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square is too large or too small."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _padded(raw: list[bytes], dtype: str, dim: int) -> np.ndarray:
    """Unit vectors of any lengths, filled up with zeros or cut to `dim` components, for projections only."""
    out = np.zeros((len(raw), dim))
    size = np.array([len(v) for v in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        x = _unit(np.stack([np.frombuffer(raw[k], dtype=dtype) for k in at]))[:, :dim]
        out[at, : x.shape[1]] = x
    return out


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, class, vector binary for every row; class and vector are null where a vector links with nothing."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, raw = [None] * b.num_rows, [None] * b.num_rows
            for rows, x in _vectors(b.column(1)):
                for k, v in zip(rows, x):
                    raw[k] = v.tobytes()
                    number[k] = xxhash.xxh3_64_intdigest(raw[k]) - (1 << 63)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "class", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, class long, vector binary")


def memberships(reps: DataFrame, forest, dtype: str, dim: int, margin: float) -> DataFrame:
    """leaf, class, n, vector, leaves array<int>: a row for each leaf of each class; leaves are numbered through all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _padded(b.column(2).to_pylist(), dtype, dim)
            found = [leaves_of(tree, x, margin) for tree, _ in forest.value]
            base = np.cumsum([0, *(n for _, n in forest.value)])
            row, leaf = np.concatenate([r for r, _ in found]), np.concatenate([k + base[t] for t, (_, k) in enumerate(found)])
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order].astype(np.int32)
            first = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(first), pa.array(leaf))
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0).take(pick), b.column(1).take(pick), b.column(2).take(pick), lists.take(pick)], names=["leaf", "class", "n", "vector", "leaves"])

    return reps.select("class", "n", "vector").mapInArrow(run, "leaf int, class long, n long, vector binary, leaves array<int>")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least node of their components over edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _spanning(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) with the same components as all that `link` has."""
    has = np.flatnonzero(link.any(1))
    if not len(has):
        return has, has
    first = link[has].argmax(1)
    rows, cols = has, first
    # a column links the row that chose it first with all its other rows
    col_has = np.flatnonzero(link.any(0))
    more = link[:, col_has].argmax(0)
    root = _roots(np.concatenate([rows, more]), np.concatenate([cols, col_has]) + link.shape[0], sum(link.shape))
    across = link & (root[: link.shape[0]][:, None] != root[link.shape[0] :][None, :])
    r, c = np.nonzero(across)
    return np.concatenate([rows, more, r]), np.concatenate([cols, col_has, c])


def compare(x: np.ndarray, y: np.ndarray, mx: np.ndarray, my: np.ndarray, wx: np.ndarray, wy: np.ndarray, same: bool, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links owned here of each row of x and y (unit vectors), weighed by wy and wx, and spanning edges (row of x, row of y).

    mx, my: which earlier leaves a row is in; a pair with one in common is counted there. same: y is x.
    """
    nx, ny = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    a, b = [], []
    for i in range(0, len(x), TILE):
        for j in range(i if same else 0, len(y), TILE):
            link = x[i : i + TILE] @ y[j : j + TILE].T >= limit
            if same and i == j:
                link &= np.tri(*link.shape, -1, dtype=bool).T
            r, c = _spanning(link)
            a.append(r + i)
            b.append(c + j)
            if len(r) and mx.shape[1]:
                link &= mx[i : i + TILE] @ my[j : j + TILE].T == 0
            nx[i : i + TILE] += link @ wy[j : j + TILE]
            ny[j : j + TILE] += link.T @ wx[i : i + TILE]
    return nx, ny, np.concatenate([*a, np.zeros(0, dtype=np.int64)]), np.concatenate([*b, np.zeros(0, dtype=np.int64)])


def leaf_links(members: DataFrame, dtype: str, limit: float) -> DataFrame:
    """class, n_links, root: what each comparison of a leaf, or of two blocks of one, gives for each member with a link there."""
    members = members.withColumn("size", F.octet_length("vector"))  # vectors of one length are compared
    large = members.groupBy("leaf", "size").count().where(F.col("count") > LEAF_ROWS).select("leaf", "size", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = members.join(large, ["leaf", "size"], "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).otherwise(0))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    tasks = dealt.select("leaf", "size", "class", "n", "vector", "leaves", "own", other.alias("other")).select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(t: pa.Table) -> pa.Table:
        leaf, lo, hi = (t.column(c)[0].as_py() for c in ("leaf", "lo", "hi"))
        number, weight, own = (t.column(c).to_numpy() for c in ("class", "n", "own"))
        x = _unit(np.stack([np.frombuffer(v, dtype=dtype) for v in t.column("vector").to_pylist()]))
        lists = t.column("leaves").combine_chunks()
        at, flat = np.repeat(np.arange(len(x)), np.asarray(pc.list_value_length(lists))), np.asarray(lists.flatten())
        before = flat < leaf
        kinds, code = np.unique(flat[before], return_inverse=True)
        earlier = np.zeros((len(x), len(kinds)), dtype=np.float32)
        earlier[at[before], code] = 1
        p, q = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        nx, ny, a, b = compare(x[p], x[q], earlier[p], earlier[q], weight[p], weight[q], lo == hi, limit)
        links = np.zeros(len(x), dtype=np.int64)
        links[p] += nx
        links[q] += ny
        order = np.argsort(number)  # the root is the least class
        rank = np.empty(len(x), dtype=np.int64)
        rank[order] = np.arange(len(x))
        root = number[order][_roots(rank[p[a]], rank[q[b]], len(x))[rank]]
        keep = (links > 0) | (root != number)
        return pa.table({"class": number[keep], "n_links": links[keep], "root": root[keep]})

    return tasks.groupBy("leaf", "size", "lo", "hi").applyInArrow(run, "class long, n_links long, root long")


def near_duplicates(vectors: DataFrame, limit: float = 0.95, trees: int = TREES, leaf: int = LEAF, margin: float = MARGIN, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    dtype = "float32" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    if dtype == "float64":
        vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = settle(classes(vectors), "vectors")
    reps = settle(rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector")), "vector-classes")
    total = reps.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    picked = reps.select("class", "vector").orderBy(F.xxhash64("class", F.lit(seed)), "class").limit(MAX_SAMPLE).toPandas().sort_values("class")
    dim = max(map(len, picked["vector"])) // np.dtype(dtype).itemsize
    sample = _padded(list(picked["vector"]), dtype, dim)
    forest = spark.sparkContext.broadcast([fit_tree(sample, len(sample) / total, margin, leaf, seed + t) for t in range(trees)])
    members = settle(memberships(reps, forest, dtype, dim, margin), "memberships")
    found = settle(leaf_links(members, dtype, limit), "leaf-links")
    grouped = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("class").agg(F.sum("n_links").alias("links"))
    named = reps.join(grouped.withColumnRenamed("node", "class"), "class", "left").join(linked, "class", "left").select("class", "vec_id", F.coalesce("component", "class").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = settle(named, "named")
    least = named.groupBy("component").agg(F.min("vec_id").cast("long").alias("component_id"))
    of_class = settle(named.join(least, "component").select("class", "n_links", "component_id"), "of-class")
    out = rows.select("vec_id", "class").join(of_class, "class", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
