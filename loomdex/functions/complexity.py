"""Code metrics that need a scan with state, as Arrow-batched UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decision points per language family.
DECISIONS = {
    "python": r"\b(?:if|elif|for|while|except|and|or|assert|case)\b",
    "c": r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?!\.)",
}
INDENTED = ("python", "ruby", "yaml")
#: Comments and literals by the languages' definitions of them.
_NOISE = {
    "python": (r'(?s)""".*?"""|\'\'\'.*?\'\'\'', r"(?m)#.*$"),
    "c": (r"(?s)/\*.*?\*/", r"(?m)//.*$"),
}
_LITERALS = (r'"(?:[^"\\]|\\.)*"', r"'(?:[^'\\]|\\.)*'", r"`(?:[^`\\]|\\.)*`")
OPEN, CLOSE = "([{<", ")]}>"


def cyclomatic(source: str, language: str | None) -> int:
    """1 and the decision points outside comments and literals."""
    family = "python" if language == "python" else "c"
    for p in _NOISE[family]:
        source = re.sub(p, "", source)
    for p in _LITERALS:
        source = re.sub(p, '""', source)
    return 1 + len(re.findall(DECISIONS[family], source))


def indent_depth(source: str) -> int:
    """Deepest indentation in steps of the first one seen, from the first code line's own."""
    indents = []
    for line in source.split("\n"):
        code = line.lstrip()
        if code and not code.startswith("#"):
            indents.append(len(line) - len(code))
    deeper = [i - indents[0] for i in indents[1:] if i > indents[0]] if indents else []
    return max(d // deeper[0] for d in deeper) if deeper else 0


def brace_depth(source: str) -> int:
    """Deepest nesting of braces outside literals, the outermost not counted."""
    depth = deepest = 0
    for brace in re.sub("|".join(_LITERALS), "", source, flags=re.S):
        if brace == "{":
            depth += 1
            deepest = max(deepest, depth)
        elif brace == "}" and depth:
            depth -= 1
    return max(0, deepest - 1)


def nesting(source: str, language: str | None) -> int:
    return indent_depth(source) if language in INDENTED else brace_depth(source)


def params(source: str, language: str | None) -> int:
    """Parameters in the first balanced parentheses; commas inside brackets don't count, a receiver isn't one."""
    start = source.find("(")
    depth, parts = 0, []
    text = ""
    for ch in source[start:] if start >= 0 else "":
        if ch in OPEN:
            depth += 1
            if depth > 1:
                text += ch
        elif ch in CLOSE and not (ch == ">" and text.endswith(("-", "="))):
            depth -= 1
            if depth <= 0:
                break
            text += ch
        elif ch == "," and depth == 1:
            parts.append(text.strip())
            text = ""
        else:
            text += ch
    if depth > 0:
        return 0
    parts = [p for p in [*parts, text.strip()] if p]
    receiver = {"python": ("self", "cls"), "rust": ("self", "&self", "&mut self", "mut self")}.get(language or "", ())
    if parts and parts[0].partition(":")[0].strip() in receiver:
        parts = parts[1:]
    return len(parts)


METRICS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cyclomatic", "max_nesting", "param_count")])


@F.pandas_udf(METRICS)
def complexity(source: pd.Series, language: pd.Series) -> pd.DataFrame:
    """Metrics of a source and its language; a null source has (1, 0, 0)."""
    pairs = [(s or "", g) for s, g in zip(source, language, strict=True)]
    return pd.DataFrame({"cyclomatic": [cyclomatic(*p) for p in pairs], "max_nesting": [nesting(*p) for p in pairs], "param_count": [params(*p) for p in pairs]}, dtype="int32")
