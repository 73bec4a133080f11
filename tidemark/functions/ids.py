"""Content ids: SHA-256 over NUL-joined parts, behind a prefix."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(prefix: str, *parts: Column | str) -> Column:
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat_ws("\0", *columns), 256))


def finding_id(detector: Column | str, signature: Column) -> Column:
    return hashed("fnd", detector, signature)


def mutation_id(finding: Column) -> Column:
    return hashed("mut", "deterministic-template/v1", finding)


def equivalence_key(detector: Column, selectors: Column) -> Column:
    """Equal for candidates with the same detector, kind of intervention and set of triggers."""
    return hashed("eqv", "equivalence/v1", detector, "agent_instruction", F.array_join(F.array_sort(selectors), "\0"))


def document_id(prefix: str, document: object) -> str:
    """Id of a JSON document, over its canonical text (declared order of keys, no blanks)."""
    return f"{prefix}_{hashlib.sha256(json.dumps(document, ensure_ascii=False, separators=(',', ':')).encode()).hexdigest()}"


def text_id(prefix: str, *parts: str) -> str:
    return f"{prefix}_{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()}"
