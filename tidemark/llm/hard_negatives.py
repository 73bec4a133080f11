"""Hard negatives by Four-Russians scoring.

Every vector becomes integers floor(256 x). Eight dimensions are a group; for each group of an anchor a table holds the
sums of all 256 subsets of its eight entries. A candidate's entries are cut into bit planes, so that a group of a plane
is a byte, the index of the table's entry; shifting and adding the looked-up sums over planes and groups gives the exact inner
product (the top plane counts negative, as in two's complement).

Anchors and candidates are dealt into a grid of blocks by hash, and each cell scores its anchors against its candidates:
first those of the anchor's own label, whose best few by cell make the positives, then those of the other labels, whose best
few in the range of each positive make the negatives. So each pair is scored once, whatever a label's share of the rows
is, and only the best of each cell leave it. Anchors are a stated query set (every 50th id) against all rows.

Rows with a null label or vector, or a null or non-finite entry, take no part; nor do those with an entry beyond +-2^31
after scaling, whose scores would not fit. Only vectors of equal length are compared (empty ones score 0). Equal rows
(id, label and entries) count once; rows that share an id with an anchor are not its other rows; an id that comes with
several vectors is several rows, and as an anchor gets the results of each, told apart by anchor_row. Ties go to the
smaller id (null last), then to the smaller row hash. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.session import settle

SCALE, GROUP = 256, 8
#: Rows of a cell's sides: the work of a cell and its memory are bounded by these, not results.
ANCHOR_ROWS, LEAST_ROWS, MOST_ROWS, CELLS = 8_192, 1_024, 32_768, 64
#: Anchors and candidates whose scores are in memory at once.
ANCHORS_AT_ONCE, CANDIDATES_AT_ONCE = 128, 8_192
NOTHING = np.iinfo(np.int64).min

ROW = "vec_id long, row long, label long, d int, entries array<int>"
CELL = "anchor_id long, anchor_row long, positive_id long, positive_row long, positive_score long, vec_id long, row long, score long"


# ---- Four-Russians scores


def planes_of(least: int, most: int) -> int:
    """Bits that hold all entries in two's complement."""
    return 1 + max(int(most).bit_length(), (~int(least)).bit_length() if least < 0 else 0)


def pack(x: np.ndarray, planes: int) -> np.ndarray:
    """uint8 (planes, groups, rows): bit planes of integer entries, eight dimensions a byte."""
    rows, d = x.shape
    groups = -(-d // GROUP)
    wide = np.zeros((rows, groups * GROUP), dtype=np.int64)
    wide[:, :d] = x
    bits = (wide[None] >> np.arange(planes)[:, None, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").reshape(planes, rows, groups).transpose(0, 2, 1)


def subset_sums(x: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of the eight entries of a group."""
    rows, d = x.shape
    groups = -(-d // GROUP)
    wide = np.zeros((rows, groups * GROUP), dtype=np.int64)
    wide[:, :d] = x
    wide = wide.reshape(rows, groups, GROUP).transpose(1, 2, 0)
    sums = np.zeros((groups, 1 << GROUP, rows), dtype=np.int64)
    for k in range(GROUP):  # subsets with entry k are those without it, and it
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + wide[:, k, None]
    return sums


def scores(tables: np.ndarray, packed: np.ndarray, bound: float) -> np.ndarray:
    """(candidates, anchors) inner products. bound: of their size, to choose the integers; planes go from the top one down."""
    planes, groups, rows = packed.shape
    kind = np.int32 if bound < 2**31 else np.int64
    tables = tables.astype(kind)
    out = np.zeros((rows, tables.shape[2]), dtype=kind)
    part = np.empty_like(out)
    for p in reversed(range(planes)):
        out += out
        for g in range(groups):
            np.take(tables[g], packed[p, g], axis=0, out=part, mode="clip")
            out = out - part if p == planes - 1 else np.add(out, part, out=out)
    return out


# ---- cells


def _best(keyed: np.ndarray, most: int) -> np.ndarray:
    """(most, rows of keyed): places of the greatest keys, in falling order; -1 where none is left. keyed is used up."""
    out = np.full((most, len(keyed)), -1)
    every = np.arange(len(keyed))
    for k in range(min(most, keyed.shape[1])):
        at = keyed.argmax(1)
        found = keyed[every, at] > NOTHING
        out[k, found] = at[found]
        keyed[every, at] = NOTHING
    return out


def _side(table) -> dict:
    """Columns of a block as arrays, ordered by id (null last) and row hash, and entries by length."""
    ids = table.column("vec_id").to_numpy(zero_copy_only=False)
    lone = np.isnan(ids) if ids.dtype.kind == "f" else np.zeros(len(ids), bool)
    whole = np.array([0 if v is None else v for v in table.column("vec_id").to_pylist()], dtype=np.int64) if lone.any() else ids.astype(np.int64)
    rows = table.column("row").to_numpy()
    order = np.lexsort((rows, whole, lone))
    return {"id": whole[order], "null": lone[order], "row": rows[order], "label": table.column("label").to_numpy()[order], "d": table.column("d").to_numpy()[order], "order": order}


def _entries(table, at: np.ndarray, d: int) -> np.ndarray:
    lists = table.column("entries").combine_chunks()
    starts = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[starts[at][:, None] + np.arange(d)]


def cell(planes: int, top: int, most: int, low: int, high: int, ranged: bool):
    """A function of a cell's anchors and candidates: the best `most` rows of an anchor's own label, or, with ranges, for each of its positives the best ones of other labels."""

    def run(left, right):
        import pyarrow as pa

        found: dict[str, list] = {k.split()[0]: [] for k in CELL.split(", ")}
        if left.num_rows and right.num_rows:
            a, c = _side(left), _side(right)
            asked = left.column("positives").to_pylist() if ranged else None
            for d in np.intersect1d(a["d"], c["d"]):
                mine, theirs = np.flatnonzero(a["d"] == d), np.flatnonzero(c["d"] == d)
                for label in np.unique(a["label"][mine]):
                    own, other = mine[a["label"][mine] == label], theirs[(c["label"][theirs] != label) if ranged else (c["label"][theirs] == label)]
                    for i in range(0, len(own), ANCHORS_AT_ONCE):
                        anchors = own[i : i + ANCHORS_AT_ONCE]
                        x = _entries(left, a["order"][anchors], d)
                        tables = subset_sums(x)
                        for j in range(0, len(other), CANDIDATES_AT_ONCE):
                            block = other[j : j + CANDIDATES_AT_ONCE]
                            packed = pack(_entries(right, c["order"][block], d), planes)
                            score = scores(tables, packed, float(d) * top * top).T.astype(np.int64)
                            # equal scores go to the row that stands first, so one number orders both
                            key = score * len(block) + np.arange(len(block) - 1, -1, -1)
                            if ranged:
                                take_ranged(found, a, c, anchors, block, score, key, [asked[k] for k in a["order"][anchors]])
                            else:
                                key[(a["id"][anchors][:, None] == c["id"][block]) & ~c["null"][block]] = NOTHING
                                put(found, a, c, anchors, block, score, _best(key, most), None)
        kinds = [pa.int64()] * len(found)
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds)], names=list(found))

    def put(found, a, c, anchors, block, score, best, positives):
        for places in best:
            for k in np.flatnonzero(places >= 0):
                at, p = places[k], None if positives is None else positives[k]
                found["anchor_id"].append(int(a["id"][anchors[k]]))
                found["anchor_row"].append(int(a["row"][anchors[k]]))
                for name, field in (("positive_id", "vec_id"), ("positive_row", "row"), ("positive_score", "score")):
                    found[name].append(None if p is None else p[field])
                found["vec_id"].append(None if c["null"][block[at]] else int(c["id"][block[at]]))
                found["row"].append(int(c["row"][block[at]]))
                found["score"].append(int(score[k, at]))

    def take_ranged(found, a, c, anchors, block, score, key, asked):
        for turn in range(max(len(p) for p in asked)):
            some = np.array([k for k, p in enumerate(asked) if len(p) > turn])
            positives = [asked[k][turn] for k in some]
            level = np.array([p["score"] for p in positives], dtype=np.int64)[:, None]
            part = 100 * score[some]
            keyed = np.where((low * level <= part) & (part <= high * level), key[some], NOTHING)
            put(found, a, c, anchors[some], block, score[some], _best(keyed, most), positives)

    return run


# ---- the operator


def labelled_rows(embeddings: DataFrame, label: Column, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """vec_id, row, label, d, entries: each different usable row once."""
    x = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.floor(c * SCALE))
    wide = embeddings.select(F.col(f"`{ident}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("c"), x.alias("x"))
    sound = F.forall("c", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * SCALE) < float(1 << 31)), F.lit(False)))
    kept = wide.where(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", "label", F.col("x").cast("array<int>").alias("entries"))
    return kept.select("vec_id", F.xxhash64("label", "entries").alias("row"), "label", F.size("entries").alias("d"), "entries").dropDuplicates(["vec_id", "row"])


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Both sides dealt to the cells of a grid by hash: anchors to a line and all columns, rows to a column and all lines."""
    wide = min(MOST_ROWS, max(LEAST_ROWS, n_rows // CELLS))
    lines, columns = -(-n_anchors // ANCHOR_ROWS), -(-n_rows // wide)
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", "row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"line": dealt(lines, 1)}).withColumn("column", every(columns))
    renewed = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # a side's columns must not be taken for the other's
    right = renewed.withColumns({"column": dealt(columns, 2)}).withColumn("line", every(lines))
    return left.groupBy("line", "column"), right.groupBy("line", "column")


def mine(embeddings: DataFrame, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row.

    A negative's score is between low and high hundredths of the positive's. every: anchors are the ids divisible by it.
    """
    rows = settle(labelled_rows(embeddings, F.col("label") if label is None else label, vector, ident), "labelled-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    told = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.min(F.array_min("entries")).alias("least"), F.max(F.array_max("entries")).alias("most")).first()
    least, most = told.least or 0, told.most or 0
    planes, top = planes_of(least, most), max(-least, most, 1)
    first = Window.partitionBy("anchor_id", "anchor_row")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"]
    if not told.anchors:
        return _empty(rows)
    left, right = _grid(anchors, rows, told.anchors, told.n)
    near = left.cogroup(right).applyInArrow(cell(planes, top, positives, low, high, False), CELL)
    best = near.withColumn("place", F.row_number().over(first.orderBy(*order))).where(F.col("place") <= positives)
    chosen = best.groupBy("anchor_id", "anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("positives"))
    asking = settle(anchors.join(chosen, (anchors["vec_id"] == chosen["anchor_id"]) & (anchors["row"] == chosen["anchor_row"])).select("vec_id", anchors["row"], "label", "d", "entries", "positives"), "anchors")
    left, right = _grid(asking, rows, told.anchors, told.n)
    hard = left.cogroup(right).applyInArrow(cell(planes, top, negatives, low, high, True), CELL)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "anchor_row", "positive_id", "positive_row").orderBy(*order))).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), "anchor_row")


def _empty(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.limit(0).select(F.col("vec_id").alias("anchor_id"), none.alias("positive_id"), F.lit(0).cast("int").alias("rank"), none.alias("negative_id"), none.alias("positive_score"), none.alias("negative_score"), F.col("row").alias("anchor_row"))
