"""Column expressions shared by the operators: severities, fingerprints, identifiers, paths, similarity."""

from __future__ import annotations

import fnmatch
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: severities, most severe first, and their ranks
SEVERITIES = ("blocking", "high", "medium", "low", "suggestion")
RANKS = {"blocking": 3, "high": 2, "medium": 1, "low": 0, "suggestion": -1}
UNKNOWN_RANK = -2
# fixed values: words that carry no meaning in identifiers, and the parts of a camel-case word
STOPWORDS = (
    "self", "cls", "the", "an", "of", "to", "in", "for", "and", "or", "not", "is", "be", "as", "if", "else", "return", "def", "class",
    "with", "from", "import", "args", "kwargs", "none", "true", "false", "str", "int", "bool", "list", "dict", "set", "tuple", "type",
)
CAMEL_PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"


def severity_rank(severity: Column) -> Column:
    out = F.lit(UNKNOWN_RANK)
    for name in reversed(SEVERITIES):
        out = F.when(severity == name, F.lit(RANKS[name])).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in SEVERITIES:
        out = F.when(rank == RANKS[name], F.lit(name)).otherwise(out)
    return out


def raised(severity: Column, floor: str) -> Column:
    """The severity, or `floor` where that is more severe."""
    return severity_name(F.greatest(severity_rank(severity), F.lit(RANKS[floor])))


def strip(text: Column) -> Column:
    """White space of any kind off both ends; trim() takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def finding_fingerprint(path: Column, rule: Column, evidence: Column) -> Column:
    nul = F.lit("\0")
    return F.sha2(F.concat(path, nul, rule, nul, strip(F.coalesce(evidence, F.lit("")))), 256)


def evidence_hash(evidence: Column) -> Column:
    return F.sha2(strip(F.coalesce(evidence, F.lit(""))), 256)


def identifier_tokens(name: Column) -> Column:
    """Lower-case parts of a snake or camel case identifier; digits are parts of their own."""
    return F.transform(F.regexp_extract_all(name, F.lit(CAMEL_PARTS), F.lit(0)), F.lower)


def meaningful(tokens: Column, stopwords=STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*stopwords))


def naming_document(head: Column, body: Column, types: Column, context: Column, weight: int = 3) -> Column:
    return F.concat(F.flatten(F.array_repeat(head, weight)), body, types, context)


def looks_like_hash(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{8,}$")


def is_sparse(tokens: Column, least: int = 4) -> Column:
    return F.size(F.array_distinct(tokens)) < least


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_blend(callees_a: Column, callees_b: Column, types_a: Column, types_b: Column) -> Column:
    return F.round(jaccard(callees_a, callees_b) * 0.6 + jaccard(types_a, types_b) * 0.4, 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def smooth_idf(documents: Column, containing: Column) -> Column:
    return F.log((documents + 1.0) / (containing + 1.0)) + 1.0


def verb(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(name, "^_+", ""), "_"), 1))


def object_tokens(name: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(name, "^_+", ""), "_"), lambda t: t != "")
    return F.array_distinct(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))


def abstractness(stub: Column, abstract: Column, higher_order: Column, callback_only: Column) -> Column:
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(F.lit(1.0), part(stub, 0.4) + part(abstract, 0.3) + part(higher_order, 0.2) + part(callback_only, 0.2))


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/__init__$", ""), "/", ".")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_glob(path: Column, pattern: str) -> Column:
    """Shell glob on the whole path or on the basename; a star crosses slashes."""
    regex = fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
    regex = f"(?s)^(?:{regex})$"
    return path.rlike(regex) | basename(path).rlike(regex)


def any_glob(path: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches_glob(path, p)
    return out


def in_directory(path: Column, names) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in names]))


def dependency_name(spec: Column) -> Column:
    return F.lower(F.regexp_extract(spec, r"^\s*([A-Za-z0-9_.\-]+)", 1))


def entry_point_names(target: Column) -> Column:
    """pkg.mod:attr -> its segments."""
    return F.filter(F.split(target, "[.:]"), lambda s: s != "")


def referenced_names(text: Column) -> Column:
    """Identifiers that a string names, as a.b or a:b."""
    whole = text.rlike(r"^[A-Za-z_][A-Za-z0-9_]*([.:][A-Za-z_][A-Za-z0-9_]*)*$")
    return F.when(whole, F.split(text, "[.:]")).otherwise(F.expr("cast(array() as array<string>)"))


def anchor_line(text: Column, *needles: Column) -> Column:
    """1-based number of the first line with all needles, else 1."""
    lines = F.split(text, "\n")
    hit = F.transform(lines, lambda x: math_and(*[x.contains(n) for n in needles]))
    return F.greatest(F.array_position(hit, True), F.lit(1)).cast("int")


def math_and(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def packed_blob(text: Column, least: int = 200) -> Column:
    """One long base64 or hexadecimal run."""
    return text.rlike(rf"^[A-Za-z0-9+/]{{{least},}}={{0,2}}$") | text.rlike(rf"^(?:[0-9a-fA-F]{{2}}){{{math.ceil(least / 2)},}}$")


def truncated(items: Column, shown: int) -> Column:
    """a, b, c (+n more)."""
    more = F.size(items) - shown
    head = F.array_join(F.slice(items, 1, shown), ", ")
    return F.when(more > 0, F.concat(head, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(head)
