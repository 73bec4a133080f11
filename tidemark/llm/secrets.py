"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger has a row for each (blob, rules version)
that was ever scanned; a scan takes the pairs that it lacks, and findings are joined back to every path
(here: row) that holds the blob. A text that stands in a million rows is scanned once for each version of
the rules, and never again in a later run.

Null text counts as empty, which has no findings. Texts of any length are scanned whole. Repeated rows and
rows with equal texts get a row each; empty tables give empty results. Extra columns of the documents are
not carried; columns named like ours in them do no harm.
Spans that begin together stand in the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import settle, unpacked


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; those with fewer than `least` characters in `group` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # a greedy run is as long as it gets, so its least length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _pieces(text: Column, rule: Rule, order: int) -> Column:
    """An element for each match: characters before it since the last match, its own, whether it counts."""
    before, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.transform(F.arrays_zip(F.slice(before, F.lit(1), F.size(found)).alias("before"), found.alias("found"), checked.alias("checked")), lambda x: F.struct(F.lit(order).alias("kind"), F.length(x["before"]).alias("before"), F.length(x["found"]).alias("own"), (F.length(x["checked"]) >= rule.least).alias("counts")))
    return F.when(text.rlike(rule.pattern), pieces)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """blob, rules, n_<kind> for each kind, spans array<struct<start, kind, end>>: a row for each distinct blob.

    blobs: columns blob, text. Spans count code points, ends are exclusive; order by start, then by rule.
    """
    once = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    found = F.concat(*(F.coalesce(_pieces(F.col("text"), r, k), F.expr("cast(array() as array<struct<kind: int, before: int, own: int, counts: boolean>>)")) for k, r in enumerate(rules)))
    rows = once.select("blob", F.posexplode_outer(found).alias("at", "piece")).select("blob", "at", "piece.*")
    # a blob's rows are in one partition already; positions are running sums over one kind's matches
    upto = "partition by blob, kind order by at rows between unbounded preceding and current row"
    placed = rows.withColumn("end", F.expr(f"sum(before + own) over ({upto})")).withColumn("start", F.col("end") - F.col("own"))
    hit = F.coalesce(F.col("counts"), F.lit(False))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    spans = F.array_sort(F.collect_list(F.when(hit, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))))
    return (
        placed.groupBy("blob")
        .agg(*(F.count_if(hit & (F.col("kind") == k)).alias(f"n_{r.kind}") for k, r in enumerate(rules)), spans.alias("spans"))
        .withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kinds[s["kind"]].alias("kind"), s["end"].alias("end"))))
        .withColumn("rules", F.lit(rules_version(rules)))
    )


def extend_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """Ledger rows that were missing: scans of the blobs in docs that `ledger` lacks under this version of the rules."""
    blobs = docs.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == rules_version(rules)).select("blob"), "blob", "left_anti")
    return settle(scan(blobs, rules), "secret-ledger")


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns, then the ledger's columns, for every row of docs."""
    keep = ["doc_id"] if keep is None else keep
    found = [c for c in ledger.columns if c not in ("blob", "rules")]
    known = ledger.where(F.col("rules") == rules_version(rules)).select("blob", F.struct(*found).alias("found"))
    paths = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), blob_of(F.col(text)).alias("blob"))
    return paths.join(known, "blob", "left").select("row.*", *(F.col("found").getField(c).alias(c) for c in found))


def span_text(spans: str = "spans") -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with every span in column text replaced by `mark` (overlapping spans by one mark); other columns stay."""
    known = ledger.where(F.col("rules") == rules_version(rules)).select("blob", "spans").where(F.size("spans") > 0)
    text = F.col("row").getField("text")
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob_of(F.col("text")).alias("blob")).join(known, "blob", "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return unpacked(marked, docs, text=F.when(F.col("spans").isNotNull(), rebuilt).otherwise(text))
