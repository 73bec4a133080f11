"""Scalar functions on text as Column expressions: normalisation, signatures, redaction, small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import GRAMMAR, LABEL_KEYS, SHELL_NAMES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: the rewrites of volatile tokens, in order (Java syntax), and what they become
_STOP = r"\s'\"(){}\[\],&|;<>`"
VOLATILE = (
    (rf"(?U)[a-zA-Z][a-zA-Z0-9+.\-]*://[^{_STOP}]*", "«url»"),
    (rf"(?U)(^|[={_STOP}:$])(/[^{_STOP}$#]+/[^{_STOP}$#]*)", "$1«path»"),
    (rf"(?U)(^|[={_STOP}:$])(~/[^{_STOP}$#]*)", "$1«path»"),
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "«uuid»"),
    (r"(?=[0-9]*[a-fA-F])[0-9a-fA-F]{8,}", "«hex»"),
    (r"[0-9]{4,}", "«n»"),
)
# fixed values: secret patterns, in order, and their replacements
SECRETS = (
    (r"(?U)\bsk-[A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    (r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"(?U)\bAKIA[A-Z0-9]{16}\b", "[REDACTED]"),
    (r"(?iU)\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer [REDACTED]"),
    (r"(?iU)\b(api[_-]?key|access[_-]?token|password|secret)\s*[:=]\s*[\"']?[A-Za-z0-9._~+/=-]{8,}[\"']?", "$1=[REDACTED]"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_tool(name: Column) -> Column:
    plain = ascii_lower(trimmed(name))
    return F.when(plain.isin(*SHELL_NAMES), "shell").otherwise(plain)


def normalize_command(command: Column, project: Column | None = None) -> Column:
    """Project path, white space and volatile tokens replaced, in this order."""
    text = command if project is None else F.when(project.isNotNull(), F.replace(command, project, F.lit("$PROJECT"))).otherwise(command)
    text = collapsed(text)
    for pattern, mark in VOLATILE:
        text = F.regexp_replace(text, pattern, mark)
    return text


def command_of(tool_input: Column) -> Column:
    """A string input as it is; of an object `command`, or `cmd` if it has no `command`, where that is a string; else null."""
    kind = F.schema_of_variant(tool_input)

    def member(key: str) -> tuple[Column, Column]:
        value = F.try_variant_get(tool_input, f"$.{key}", "variant")
        return value, F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(tool_input, f"$.{key}", "string"))

    (command, text), (_, fallback) = member("command"), member("cmd")
    return F.when(kind == "STRING", F.try_variant_get(tool_input, "$", "string")).when(kind.startswith("OBJECT"), F.when(command.isNotNull(), text).otherwise(fallback))


def operation(tool_name: Column, command: Column, project: Column) -> Column:
    """tool|command of an operation; null without a tool or a command with content."""
    tool, text = normalize_tool(tool_name), normalize_command(command, project)
    return F.when((F.length(tool) > 0) & (F.length(text) > 0), F.concat(tool, F.lit("|"), text))


def operation_key(op: Column) -> Column:
    return F.concat(F.lit(f"operation/{GRAMMAR}|"), op)


def failure_signature(op: Column, exit_code: Column) -> Column:
    return F.concat(F.lit(f"failure/{GRAMMAR}|"), op, F.lit("|exit:"), exit_code.cast("string"))


def operation_label(op: Column) -> Column:
    """tool: command"""
    return F.regexp_replace(op, r"(?s)^([^|]*)\|", "$1: ")


def normalized_label(c: Column) -> Column:
    return ascii_lower(collapsed(c))


def metadata_text(metadata: Column, key: str) -> Column:
    """A string value of a metadata object; null for other types."""
    value = F.try_variant_get(metadata, f"$['{key}']", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(metadata, f"$['{key}']", "string"))


def correction_label(metadata: Column, keys: tuple[str, ...] = LABEL_KEYS) -> Column:
    label = normalized_label(F.coalesce(*(metadata_text(metadata, k) for k in keys)))
    return F.when(F.length(label) > 0, label)


def truncated(c: Column, n: int = 160) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def redacted(c: Column) -> Column:
    for pattern, mark in SECRETS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def was_redacted(before: Column, after: Column) -> Column:
    return F.when(before.eqNullSafe(after), 0).otherwise(1)


def event_selector(type_: Column, tool_name: Column, exit_code: Column, label: Column) -> Column:
    """event/v1|type:…[|tool:…][|exit:…][|classification:…]; absent parts are left out."""
    tool = F.when(tool_name.isNotNull(), F.concat(F.lit("tool:"), normalized_label(tool_name)))
    code = F.when(tool_name.isNotNull() & exit_code.isNotNull(), F.concat(F.lit("exit:"), exit_code.cast("string")))
    return F.concat_ws("|", F.lit("event/v1"), F.concat(F.lit("type:"), type_), tool, code, F.when(label.isNotNull(), F.concat(F.lit("classification:"), label)))


_FAILURE_SELECTOR = r"(?s)^failure/([^|]*)[|](.*[|].*)[|]exit:([+-]?\d+)$"


def parsed_selector(selector: Column) -> Column:
    """operation_key and exit_code (null: any) that a selector asks for; null if it is neither a failure nor an operation."""
    failure = F.struct(F.concat(F.lit("operation/"), F.regexp_extract(selector, _FAILURE_SELECTOR, 1), F.lit("|"), F.regexp_extract(selector, _FAILURE_SELECTOR, 2)).alias("operation_key"), F.regexp_extract(selector, _FAILURE_SELECTOR, 3).try_cast("long").alias("exit_code"))
    plain = F.struct(selector.alias("operation_key"), F.lit(None).cast("long").alias("exit_code"))
    return F.when(selector.rlike(_FAILURE_SELECTOR), failure).when(selector.startswith("operation/"), plain)


def grammar_version(signature: Column) -> Column:
    return F.regexp_extract(signature, r"^[^/]*/v(\d+)(?:\||$)", 1).try_cast("int")


def basis_points(part: str, whole: str) -> Column:
    return F.expr(f"case when {whole} = 0 then 0 else ({part}) * 10000 div ({whole}) end")


def exit_code_of(text: Column) -> Column:
    """Number on the first line that reads `Exit code N`."""
    return F.regexp_extract(text, r"(?m)^[ \t]*Exit code [ \t]*([+-]?\d+)[ \t]*$", 1).try_cast("long")


def relative_age(then: Column, now: Column) -> Column:
    """s, m, h or d; from a week on the minute."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 60, F.concat(F.greatest(s, F.lit(0)).cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h"))).when(s < 604800, F.concat(F.floor(s / 86400), F.lit("d"))).otherwise(F.date_format(then, "yyyy-MM-dd HH:mm"))


def glob_regex(glob: str) -> str:
    """A Java regex for a glob: ** and * cross separators, ? is a character, [..] and {a,b} as usual."""
    import re

    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            if out.endswith("/") and glob[i : i + 1] == "/" and glob[i - 2 : i] == "**":
                out, i = out + "(?:.*/)?", i + 1
            else:
                out += ".*"
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def short_id(c: Column, keep: int = 8) -> Column:
    """An id's kind and the first `keep` characters behind the last underscore."""
    return F.regexp_replace(c, rf"(?s)^(.*_[^_]{{{keep}}})[^_]+$", "$1…")


def percent(bps: Column, signed: bool = False) -> Column:
    return F.format_string("%+.1f%%" if signed else "%.1f%%", bps.cast("double") / 100)


def per_week(milli: Column) -> Column:
    return F.format_string("%.1f/wk", milli.cast("double") / 1000)
