"""Merkle fixity audit of archived records.

Records are framed as in a WARC file and hashed. FANOUT consecutive record numbers make a leaf, which knows
the bytes they fill; FANOUT leaves make an archive file, in which leaves stand at their offsets in order; and
so on up to the roots. A node's hash covers its children's hashes, numbers and bytes in order. Replicas are
compared from the roots down, and only below nodes that differ, until the damaged records are named with the
offset range to fetch again.

In a leaf the records stand at offsets in the order of number (null first) and digest, equal rows side by side.
A leaf sums up hashes of its records' offsets, lengths, copies and digests, so that order and offsets count and
yet a record number that holds many rows is added up before it is shuffled: offsets come from running sums in
chunks of a number's digests and over these chunks. Null payloads, urls or numbers are records like any other
(null and empty differ by their length field); an empty replica lacks everything; equal rows are counted. Extra
columns are not read. Payloads of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import settle

BITS = 6
FANOUT = 1 << BITS
#: Leading hex digits of a digest that name a chunk of a number's records: at most 16 ** CHUNK chunks a number.
CHUNK = 3


def framed(url: Column, payload: Column) -> Column:
    """A record as text: header, blank line, payload, two line ends."""
    length = F.coalesce(F.octet_length(payload).cast("string"), F.lit("unknown"))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), length, F.lit("\r\n\r\n"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))


def records(rows: DataFrame, number: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """number, digest, size, leaf: a row for each record."""
    record = framed(F.col(url), F.col(payload))
    return rows.select(F.col(number).alias("number"), F.sha2(record.cast("binary"), 256).alias("digest"), F.octet_length(record).cast("long").alias("size"), F.shiftright(F.coalesce(F.col(number), F.lit(-1)), BITS).cast("long").alias("leaf"))


def _chunk(k: int) -> Column:
    return F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")


def height(*replicas: DataFrame) -> int:
    """Levels of a tree that takes in all record numbers."""
    spans = [x.agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).first() for x in replicas]
    widest = max((max(s["high"], ~s["low"]) for s in spans if s["low"] is not None), default=0)
    return 1 + -(-widest.bit_length() // BITS)


def placed(found: DataFrame) -> DataFrame:
    """leaf, number, digest, size, copies, filled, offset: different records, the bytes of their copies, and where these begin in the leaf."""
    once = found.groupBy("leaf", "number", "digest").agg(F.count("*").alias("copies"), F.min("size").alias("size")).withColumns({"filled": F.col("size") * F.col("copies"), "chunk": F.substring("digest", 1, CHUNK)})
    once = settle(once, "records-once")
    before = "coalesce(sum(filled) over (partition by {} order by {} rows between unbounded preceding and 1 preceding), 0)"
    chunks = once.groupBy("leaf", "number", "chunk").agg(F.sum("filled").alias("filled"))
    chunks = chunks.select(F.col("leaf").alias("leaf_c"), F.col("number").alias("number_c"), F.col("chunk").alias("chunk_c"), F.expr(before.format("leaf", "number nulls first, chunk")).alias("begin"))
    inside = once.withColumn("offset", F.expr(before.format("leaf, number, chunk", "digest")))
    both = inside.join(chunks, (F.col("leaf") == F.col("leaf_c")) & F.col("number").eqNullSafe(F.col("number_c")) & (F.col("chunk") == F.col("chunk_c")))
    return both.select("leaf", "number", "digest", "size", "copies", "filled", (F.col("begin") + F.col("offset")).alias("offset"))


def tree(found: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes (node, hash, bytes, records, start) from leaves to roots; start: offset in the parent's bytes.

    There is one root, and one more if numbers below zero or null occur.
    """
    record = F.concat_ws("|", F.coalesce(F.col("number").cast("string"), F.lit("none")), "offset", "size", "copies", "digest")
    sums = [F.sum(_chunk(k)).cast("string") for k in range(4)]
    level = placed(found).withColumn("digest", F.sha2(record, 256)).groupBy(F.col("leaf").alias("node")).agg(F.sum("copies").alias("records"), F.sum("filled").alias("bytes"), F.concat_ws("|", *sums).alias("sums"))
    level = level.select("node", F.sha2(F.concat_ws("|", "node", "records", "bytes", "sums"), 256).alias("hash"), "bytes", "records")
    start = F.expr(f"coalesce(sum(bytes) over (partition by shiftright(node, {BITS}) order by node rows between unbounded preceding and 1 preceding), 0)")
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash", "bytes"))), lambda c: F.concat_ws(":", c["node"], c["hash"], c["bytes"])), "|")
    out: list[DataFrame] = []
    for k in range(levels):
        if k:  # at most FANOUT children each
            level = level.groupBy(F.shiftright("node", BITS).alias("node")).agg(F.sha2(children, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))
        level = settle(level.withColumn("start", start), f"level-{k}")
        out.append(level)
    return out


def mismatching_leaves(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """node, start, bytes (of the primary; null where it has no such leaf) of leaves that differ, found by descent from the roots."""
    suspects: DataFrame | None = None
    for k in reversed(range(len(primary))):
        sides = [primary[k], replica[k]]
        if suspects is not None:
            below = suspects.select(F.col("node").alias("parent"))
            sides = [x.join(below, F.shiftright(x["node"], BITS) == below["parent"], "left_semi") for x in sides]
        a, b = (x.select(F.col("node").alias(f"node_{s}"), F.col("hash").alias(f"hash_{s}"), F.col("start").alias(f"start_{s}"), F.col("bytes").alias(f"bytes_{s}")) for x, s in zip(sides, "ab"))
        differ = a.join(b, F.col("node_a") == F.col("node_b"), "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        suspects = settle(differ.select(F.coalesce("node_a", "node_b").alias("node"), F.col("start_a").alias("start"), F.col("bytes_a").alias("bytes")), f"suspects-{k}")
    return suspects


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """number, digest, n_primary, n_replica, leaf, range_start, range_bytes: each record whose copies differ in number.

    primary, replica: results of records(). A changed record appears once for either digest. The range is that of
    its leaf in the primary's archive file.
    """
    primary, replica = settle(primary, "primary"), settle(replica, "replica")
    levels = height(primary, replica)
    leaves = mismatching_leaves(tree(primary, levels), tree(replica, levels))
    sides = []
    for x, sign in ((primary, "n_primary"), (replica, "n_replica")):
        sides.append(x.join(leaves.select(F.col("node").alias("leaf")), "leaf", "left_semi").groupBy("leaf", "number", "digest").agg(F.count("*").alias(sign)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).groupBy("leaf", "number", "digest").agg(F.coalesce(F.sum("n_primary"), F.lit(0)).alias("n_primary"), F.coalesce(F.sum("n_replica"), F.lit(0)).alias("n_replica"))
    return both.where("n_primary <> n_replica").join(leaves.select(F.col("node").alias("leaf"), F.col("start").alias("range_start"), F.col("bytes").alias("range_bytes")), "leaf").select("number", "digest", "n_primary", "n_replica", "leaf", "range_start", "range_bytes")
