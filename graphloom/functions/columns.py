"""Column functions: routes, paths, languages, hashes, ranks. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of an edge's confidence, for merging and for tracing.
MERGE_RANK = {"Heuristic": 0, "SyntaxFallback": 1, "Semantic": 2, "Exact": 3}
TRACE_TYPE = {"ApiCall": 4, "EndpointHandler": 4, "DataFlow": 3, "Calls": 2}
# Languages by file name extension.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "qml": "qml"}


def lookup(key: Column, values: dict, other) -> Column:
    found = F.lit(other) if other is not None else F.lit(None).cast("string")
    for k, v in values.items():
        found = F.when(key == k, F.lit(v)).otherwise(found)
    return found


def route_path(path: Column) -> Column:
    """Trimmed, with one leading slash and no trailing ones; '/' for an empty path."""
    bare = F.regexp_replace(F.trim(path), "/+$", "")
    return F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def route_key(method: Column, path: Column) -> Column:
    return F.concat_ws(" ", F.upper(F.trim(method)), route_path(path))


def route_key_of_label(label: Column) -> Column:
    """'VERB path' of a label, null without white space in it."""
    found = F.regexp_extract(F.trim(label), r"^(\S+)\s+(.*)$", 0) != ""
    return F.when(found, route_key(F.regexp_extract(F.trim(label), r"^(\S+)\s+(.*)$", 1), F.regexp_extract(F.trim(label), r"^(\S+)\s+(.*)$", 2)))


def api_path(path: Column) -> Column:
    """An /api/ path without query, quotes around it and trailing slashes, its parameters as :param; null for others."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(path), r"\?.*$", ""), r"""^["'`]+|["'`]+$""", ""), "/+$", "")
    named = F.transform(F.split(cut, "/"), lambda s: F.when(s.startswith(":") | F.contains(s, F.lit("${")), ":param").otherwise(s))
    return F.when(cut.startswith("/api/"), F.array_join(named, "/"))


def language_of_path(path: Column) -> Column:
    return lookup(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), LANGUAGES, None)


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, as 16 hex digits. The state is two 32-bit halves, so no product overflows."""
    octets = F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != "")
    prime = 435  # the prime is 2^40 + 435
    word = F.lit(1 << 32)

    def step(state: Column, octet: Column) -> Column:
        low = state["lo"].bitwiseXOR(F.conv(octet, 16, 10).cast("bigint"))
        part = low * prime
        high = state["hi"] * prime + F.floor(part / word).cast("bigint") + low * 256
        return F.struct(F.pmod(high, word).alias("hi"), F.pmod(part, word).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    end = F.aggregate(octets, start, step)
    return F.lower(F.concat(F.lpad(F.hex(end["hi"]), 8, "0"), F.lpad(F.hex(end["lo"]), 8, "0")))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def flow_identity(label: Column, evidence: Column) -> Column:
    """What tells data-flow edges of one pair apart: a hash of label and evidence, 'flow' if both are blank."""
    blank = (one_line(label) == "") & (one_line(evidence) == "")
    return F.when(blank, "flow").otherwise(fnv1a64(F.concat(one_line(label), F.lit("\n"), one_line(evidence))))


def brace_delta(line: Column) -> Column:
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return count("{") - count("}")


def complexity(functions: Column) -> Column:
    return F.when(functions <= 5, "low").when(functions <= 14, "medium").otherwise("high")


def trace_rank(edge_type: Column, confidence: Column, evidence: Column) -> Column:
    return lookup(confidence, MERGE_RANK, 0) + 1 + lookup(edge_type, TRACE_TYPE, 1) + evidence.isNotNull().cast("int")


def callable_kind(name: Column) -> Column:
    """What a TypeScript function is by its name: a hook, a component, or a function."""
    return F.when(name.rlike("^use[A-Z]"), "Hook").when(name.rlike("^[A-Z]"), "Component").otherwise("Function")
