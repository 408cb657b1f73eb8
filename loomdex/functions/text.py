"""Text expressions over code and documents, all built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns whose matches define results.
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
URL = r"https?://[^\s\)\]\}>\"'`,;]+"
TAG = r"(?m)(?:^|(?<=\s))#([A-Za-z][A-Za-z0-9_-]{1,})"
BRANCH = r"\b(if|elif|else|for|while|except|catch|case|switch|and|or|&&|\|\|)\b"
PARAMETERS, RECEIVERS = r"\(([^)]*)\)", ("self", "cls")
#: What is taken out of a body before bodies are compared, in this order.
BODY_NOISE = ((r'(?s)""".*?"""', ""), (r"(?s)'''.*?'''", ""), (r"(?m)#.*$", ""), (r'"[^"]*"', '""'), (r"'[^']*'", "''"), (r"\s+", " "))
FTS_KEYWORDS = ("AND", "OR", "NOT", "NEAR")


def identifier_tokens(name: Column) -> Column:
    """Lower-cased parts of an identifier, split at case changes and ``_ - . /``; parts of one letter go."""
    parts = F.split(F.regexp_replace(name, CAMEL, "_"), r"[_\-./]")
    return F.transform(F.filter(parts, lambda t: F.length(t) >= 2), F.lower)


def keywords(name: Column, docstring: Column, decorators: Column) -> Column:
    first_line = F.lower(F.split(F.coalesce(docstring, F.lit("")), "\n")[0])
    heads = F.filter(F.transform(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: F.lower(F.regexp_extract(d, r"(?U)^@?(\w+)", 1))), lambda d: d != "")
    return F.array_sort(F.array_distinct(F.concat(identifier_tokens(name), F.regexp_extract_all(first_line, F.lit(r"(?U)\b[a-z]{3,}\b"), F.lit(0)), heads)))


def summary(docstring: Column, signature: Column, name: Column) -> Column:
    """The docstring's first line up to a full stop within 120 characters, else 120 of it; else the signature's; else the name."""
    line = F.trim(F.split(F.trim(docstring), "\n")[0])
    stop = F.instr(line, ".")
    said = F.when((stop > 1) & (stop <= 120), F.substr(line, F.lit(1), stop)).otherwise(F.substring(line, 1, 120))
    return F.when(F.coalesce(F.length(F.trim(docstring)), F.lit(0)) > 0, said).when(F.coalesce(F.length(signature), F.lit(0)) > 0, F.substring(signature, 1, 120)).otherwise(name)


def relatedness(same_file: Column, a: Column, b: Column) -> Column:
    """3 for the same file and half a point for each shared token of two token arrays."""
    return F.when(same_file, 3.0).otherwise(0.0) + 0.5 * F.size(F.array_intersect(a, b))


def match_score(query: Column, name: Column) -> Column:
    """1 for equal names, 0.8 for a substring, else 0.6 of the share of query words found; case is ignored."""
    q, n = F.lower(query), F.lower(name)
    words = F.filter(F.split(q, r"[\s_]+"), lambda w: w != "")
    found = F.filter(words, lambda w: F.contains(n, w))
    return F.when(q == n, 1.0).when(F.contains(n, q), 0.8).when(F.size(words) > 0, 0.6 * F.size(found) / F.size(words)).otherwise(0.0)


def estimated_complexity(source: Column) -> Column:
    """1 and the branch words; ``&&`` and ``||`` of the pattern count only where letters stand on both sides, as it asks for word boundaries."""
    return 1 + F.regexp_count(source, F.lit(BRANCH))


def naive_params(signature: Column) -> Column:
    """Comma-separated names in the first parentheses, without self and cls."""
    inside = F.regexp_extract(signature, PARAMETERS, 1)
    return F.size(F.filter(F.split(inside, ","), lambda p: (F.trim(p) != "") & ~F.trim(p).isin(*RECEIVERS)))


def normalized_body(source: Column) -> Column:
    """Code without docstrings, comments, literals' contents and line structure."""
    out = source
    for pattern, new in BODY_NOISE:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def has_types(signature: Column) -> Column:
    s = F.coalesce(signature, F.lit(""))
    return F.contains(s, F.lit("->")) | F.contains(s, F.lit(": ")) | s.rlike(r"(?U):\s*\w+")


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """Text of a byte range of UTF-8 content; broken characters are replaced."""
    raw = content if isinstance(content, str) else F.encode(content, "utf-8")
    return F.decode(F.substring(raw, offset + 1, length), "utf-8")


def context_lines(content: Column, first: Column, last: Column, around: int = 3) -> Column:
    """Lines ``first..last`` (from 1) with ``around`` more on either side, 50 at most."""
    n = max(0, min(50, around))
    start = F.greatest(F.lit(1), first - n)
    return F.array_join(F.slice(F.split(content, "\n"), start, last + n - start + 1), "\n")


def drifted(source: Column, stored_hash: Column) -> Column:
    return F.sha2(source, 256) != stored_hash


def urls(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(URL), F.lit(0)))


def tags(content: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(content, F.lit(TAG), F.lit(1)))


def token_estimate(entry: Column) -> Column:
    """A quarter of the JSON text's characters, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.to_json(entry)) / 4))


def reduction_percent(returned: Column, equivalent: Column) -> Column:
    return F.when(equivalent > 0, F.round((1 - returned / equivalent) * 100, 1)).otherwise(0.0)


def symbol_text(qualified: Column, signature: Column, docstring: Column, said: Column) -> Column:
    """What a symbol's vector is made of."""
    return F.concat_ws(" ", qualified, signature, F.substring(docstring, 1, 500), said)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def is_peak(ts: Column) -> Column:
    """Monday to Friday, 13 to 19 hours UTC."""
    return F.dayofweek(ts).between(2, 6) & (F.hour(ts) >= 13) & (F.hour(ts) < 19)


def json_list(column: Column) -> Column:
    """A JSON text as a list of strings; null, blank and broken ones are empty lists."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def json_map(column: Column) -> Column:
    """A JSON text as a map of strings; null, blank and broken ones are empty maps."""
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def to_json_text(column: Column) -> Column:
    """A list or map as JSON text; null stays null."""
    return F.to_json(column)


def enriched(keywords_: Column, provided: Column) -> Column:
    """Keywords with those that a provider adds, sorted, each once."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(keywords_, none), F.coalesce(provided, none)))


def fts_terms(query: str) -> list[str]:
    """Search terms of a user's text: anything but letters, digits, ``_`` and ``-`` parts them; keywords and single letters go."""
    import re

    words = re.sub(r"[^\w\s-]", " ", query).split()
    return [w for w in words if len(w) >= 2 and w.upper() not in FTS_KEYWORDS]
