"""Constraints of a store, as a table of rules.

A rule names a table, its columns and what must hold. Rules over one row are compiled into one expression, so that a table is read
once for all of them; uniqueness is a count by key, references are anti-joins against the distinct keys referred to. Violations are rows
(table, rule, key, value), to be counted, shown or refused (`verified`); tables that are not given are not looked at, nor are references to them.

A null breaks no rule but `given`, as in SQL's CHECK.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import EVENT_TYPES


@dataclass(frozen=True)
class Rule:
    table: str
    kind: str  # given, prefix, one_of, at_least, json, hash, filled, some, unique, refers
    columns: tuple[str, ...]
    than: object = None

    @property
    def name(self) -> str:
        return f"{self.kind}({','.join(self.columns)})"

    def broken(self) -> Column:
        """Whether a row breaks a rule over one row."""
        c = F.col(self.columns[0])
        if self.kind == "given":
            return reduce(lambda a, b: a | b, (F.col(x).isNull() for x in self.columns))
        if self.kind == "prefix":
            return ~(c.startswith(self.than) & (F.length(c) > len(self.than)))
        if self.kind == "one_of":
            return ~c.isin(*self.than)
        if self.kind == "at_least":
            return c < self.than
        if self.kind == "json":
            return c.isNotNull() & F.try_parse_json(c).isNull()
        if self.kind == "hash":
            return ~c.rlike(f"^[0-9a-f]{{{self.than}}}$")
        if self.kind == "filled":
            return ~F.length(F.trim(c)).between(1, self.than or (1 << 30))
        if self.kind == "some":
            return F.coalesce(*self.columns).isNull()
        raise ValueError(f"no rule over one row: {self.kind}")


def _rules(table: str, *rules: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(table, kind, columns if isinstance(columns, tuple) else (columns,), *than) for kind, columns, *than in rules)


_STATES = ("candidate", "challenged", "replay_passed", "shadow_passed", "active", "retired", "rejected")
#: What the tables of a store must hold.
RULES = (
    *_rules("sources", ("filled", "adapter", 128), ("filled", "instance_key"), ("unique", ("adapter", "instance_key"))),
    *_rules("sessions", ("given", "session_id"), ("unique", "session_id"), ("prefix", "session_id", "ses_"), ("given", ("source", "first_event_at", "last_event_at")), ("at_least", "events", 0)),
    *_rules("events", ("given", ("event_id", "session_id", "occurred_at", "type", "content_hash")), ("unique", "event_id"), ("unique", ("session_id", "sequence")), ("prefix", "event_id", "evt_"), ("prefix", "parent_event_id", "evt_"), ("one_of", "type", EVENT_TYPES), ("at_least", "sequence", 0), ("json", "metadata_json"), ("hash", "content_hash", 64), ("refers", "session_id", ("sessions", "session_id"))),
    *_rules("event_artifacts", ("given", ("event_id", "artifact_id")), ("at_least", "ordinal", 0), ("some", ("path", "uri", "digest")), ("refers", "event_id", ("events", "event_id")), ("refers", "artifact_id", ("artifacts", "artifact_id"))),
    *_rules("quarantine", ("hash", "content_hash", 64), ("at_least", "observation_count", 1), ("refers", "event_id", ("events", "event_id"))),
    *_rules("cursors", ("filled", "adapter", 128), ("filled", "instance_key"), ("filled", "origin"), ("at_least", "position", 0), ("unique", ("adapter", "instance_key", "origin"))),
    *_rules("candidates", ("prefix", "mutation_id", "mut_"), ("unique", "mutation_id"), ("prefix", "finding_id", "fnd_"), ("unique", "finding_id"), ("prefix", "equivalence_key", "eqv_"), ("unique", "equivalence_key"), ("one_of", "state", _STATES)),
    *_rules("evidence", ("one_of", "role", ("support", "counterexample")), ("refers", "mutation_id", ("candidates", "mutation_id")), ("refers", "event_id", ("events", "event_id"))),
    *_rules("transitions", ("one_of", "from_state", _STATES[:5]), ("one_of", "to_state", _STATES), ("refers", "mutation_id", ("candidates", "mutation_id"))),
    *_rules("attestations", ("prefix", "attestation_id", "att_"), ("one_of", "kind", ("replay", "shadow")), ("json", "report_json"), ("refers", "mutation_id", ("candidates", "mutation_id"))),
    *_rules("efficacy", ("prefix", "efficacy_id", "eff_"), ("json", "report_json"), ("refers", "mutation_id", ("candidates", "mutation_id")), ("refers", "event_id", ("events", "event_id"))),
)
KEYS = {"sources": "adapter", "sessions": "session_id", "events": "event_id", "event_artifacts": "event_id", "quarantine": "event_id", "cursors": "origin", "candidates": "mutation_id", "evidence": "mutation_id", "transitions": "mutation_id", "attestations": "attestation_id", "efficacy": "efficacy_id"}


def violations(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """table, rule, key, value: a row for each broken rule and row; of a key that isn't unique one row."""
    found = []
    for name, frame in tables.items():
        own = [r for r in rules if r.table == name and set(r.columns) <= set(frame.columns)]
        key = F.col(KEYS.get(name, frame.columns[0])).cast("string")
        told = lambda r: F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in r.columns)), ",")
        by_row = [r for r in own if r.kind not in ("unique", "refers")]
        if by_row:
            broken = F.array_compact(F.array(*(F.when(r.broken(), F.struct(F.lit(r.name).alias("rule"), key.alias("key"), told(r).alias("value"))) for r in by_row)))
            found.append(frame.select(F.explode(broken).alias("v")).select(F.lit(name).alias("table"), "v.rule", "v.key", "v.value"))
        for r in own:
            whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in r.columns))
            if r.kind == "unique":
                twice = frame.where(whole).groupBy(*r.columns).agg(F.count("*").alias("__n"), F.min(key).alias("__key")).where("__n > 1")
                found.append(twice.select(F.lit(name).alias("table"), F.lit(r.name).alias("rule"), F.col("__key").alias("key"), told(r).alias("value")))
            elif r.kind == "refers" and r.than[0] in tables:
                there = tables[r.than[0]].select(F.col(r.than[1]).alias("__there")).distinct()
                lost = frame.where(whole).join(there, F.col(r.columns[0]) == F.col("__there"), "left_anti")
                found.append(lost.select(F.lit(name).alias("table"), F.lit(r.name).alias("rule"), key.alias("key"), told(r).alias("value")))
    if not found:
        raise ValueError("no rule applies to these tables")
    return reduce(DataFrame.unionByName, found)


def verified(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> dict[str, DataFrame]:
    """The tables, if they keep all rules; else an error that names the first violation."""
    first = violations(tables, rules).orderBy("table", "rule", "key").first()
    if first is not None:
        raise ValueError(f"{first['table']} {first['key']} breaks {first['rule']}: {first['value']!r}")
    return tables
