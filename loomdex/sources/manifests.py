"""Dependency manifests and path aliases."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPENDENCY = "path string, manager string, name string, version string"


def _requirements(text: str) -> Iterator[tuple[str, str, str]]:
    for line in text.splitlines():
        if m := re.match(r"\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([\w.*+-]+))?", line.split("#")[0]):
            yield "pip", m[1], m[2] or ""


def _pyproject(text: str) -> Iterator[tuple[str, str, str]]:
    data = tomllib.loads(text)
    for spec in data.get("project", {}).get("dependencies", []):
        yield from _requirements(spec)
    for name, v in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            yield "pip", name, (v if isinstance(v, str) else str(v.get("version", ""))).lstrip("^~=<>! ")


def _package_json(text: str) -> Iterator[tuple[str, str, str]]:
    data = json.loads(text)
    for part in ("dependencies", "devDependencies"):
        for name, v in (data.get(part) or {}).items():
            yield "npm", name, str(v).lstrip("^~=<>v ")


def _go_mod(text: str) -> Iterator[tuple[str, str, str]]:
    for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+|[\w.-]+/\S+)\s+(v[\w.+-]+)", text, re.M):
        yield "go", m[1], m[2]


def _cargo(text: str) -> Iterator[tuple[str, str, str]]:
    for name, v in tomllib.loads(text).get("dependencies", {}).items():
        yield "cargo", name, v if isinstance(v, str) else str(v.get("version", ""))


PARSERS = {"requirements.txt": _requirements, "pyproject.toml": _pyproject, "package.json": _package_json, "go.mod": _go_mod, "Cargo.toml": _cargo}


def parse(name: str, text: str) -> list[tuple[str, str, str]]:
    """(manager, name, version) of a manifest; a broken one has none."""
    try:
        return list(PARSERS[name](text)) if name in PARSERS else []
    except (ValueError, AttributeError, TypeError):
        return []


def dependencies(files: DataFrame) -> DataFrame:
    """``DEPENDENCY`` rows of the manifests among ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *d) for p, text in zip(pdf["path"], pdf["content"], strict=True) for d in parse(p.rpartition("/")[2], text or "")]
            yield pd.DataFrame(rows, columns=["path", "manager", "name", "version"])

    mine = files.filter(F.element_at(F.split("path", "/"), -1).isin(*PARSERS))
    return mine.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, DEPENDENCY)


_STRING = r'("(?:[^"\\]|\\.)*")'


def _jsonc(text: str) -> dict:
    """JSON with comments and trailing commas; strings are left alone."""
    bare = re.sub(_STRING + r"|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.S)
    return json.loads(re.sub(_STRING + r"|,(?=\s*[}\]])", lambda m: m[1] or "", bare))


def path_aliases(text: str, others: dict[str, str] | None = None, path: str = "tsconfig.json") -> dict[str, list[str]]:
    """``compilerOptions.paths`` of a tsconfig, comments and trailing commas allowed, resolved against its base folder.

    ``others`` are texts by path: a config that ``extends`` one of them has its aliases too, its own going first; a missing
    or circular one adds nothing.
    """
    from posixpath import dirname, join, normpath

    def load(at: str, body: str, seen: frozenset[str]) -> dict[str, list[str]]:
        data = _jsonc(body)
        found: dict[str, list[str]] = {}
        parents = data.get("extends", [])
        for parent in [parents] if isinstance(parents, str) else parents:
            for place in (normpath(join(dirname(at), parent)), normpath(join(dirname(at), parent + ".json"))):
                if place in (others or {}) and place not in seen:
                    found |= load(place, others[place], seen | {place})
                    break
        options = data.get("compilerOptions", {})
        base = normpath(join(dirname(at), options.get("baseUrl", ".")))
        return found | {k: [normpath(join(base, t)) for t in v] for k, v in options.get("paths", {}).items()}

    return load(path, text, frozenset({path}))


def psr4(text: str) -> dict[str, str]:
    """Namespace prefixes and their folders of a composer file."""
    data = json.loads(text)
    out: dict[str, str] = {}
    for part in ("autoload", "autoload-dev"):
        for ns, folder in data.get(part, {}).get("psr-4", {}).items():
            out[ns] = folder if isinstance(folder, str) else folder[0]
    return out


def dbt_models(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(model, description, columns) of a ``schema.yml``: the lists of ``models`` and of sources' ``tables``, by indentation; other keys are passed over."""
    found: list[list] = []
    stack: list[tuple[int, str]] = []  # (indent, key) of the open lists
    at, block = None, None
    for raw in text.splitlines():
        if not raw.strip() or raw.lstrip().startswith("#"):
            continue
        indent = len(raw) - len(raw.lstrip())
        if block is not None and indent > block[0]:
            block[1](raw.strip())
            continue
        block = None
        dash = raw.lstrip().startswith("- ")
        key, _, value = raw.strip().removeprefix("- ").partition(":")
        key, value = key.strip(), value.strip().strip("\"'")
        stack = [x for x in stack if x[0] < indent or (x[0] == indent and dash)]
        owner = stack[-1][1] if stack else ""
        if dash and key == "name" and owner in ("models", "tables", "columns"):
            if owner == "columns" and found:
                found[-1][2][value] = ""
                at = (found[-1][2], value)
            elif owner != "columns":
                found.append([value, "", {}])
                at = (found[-1], 1)
        elif key == "description" and at is not None:
            holder, place = at
            if value[:1] in (">", "|"):
                holder[place] = ""

                def more(line: str, holder=holder, place=place) -> None:
                    holder[place] = f"{holder[place]} {line}".strip()

                block = (indent, more)
            else:
                holder[place] = value
        elif not value:
            stack.append((indent, key))
    return [(m, d, c) for m, d, c in found]


def dbt_columns(files: DataFrame) -> DataFrame:
    """``(model, description, columns)`` of the ``schema.yml`` files among ``files(path, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [m for text in pdf["content"] for m in dbt_models(text or "")]
            yield pd.DataFrame(rows, columns=["model", "description", "columns"])

    mine = files.filter(F.element_at(F.split("path", "/"), -1).rlike(r"^(?:_?schema|sources|.*__models)\.ya?ml$"))
    return mine.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, "model string, description string, columns map<string, string>")


def columns_of(models: DataFrame, pattern: str, query: str) -> DataFrame:
    """``(model, column, description, score)`` of ``models(model, columns map<string, string>)``: a glob on the model, anchored at its start, and the match score."""
    from loomdex.functions.text import match_score

    prefix = "(?i)^" + ".*".join(re.escape(p) for p in pattern.split("*"))
    each = models.filter(F.col("model").rlike(prefix)).select("model", F.explode("columns").alias("column", "description"))
    return each.withColumn("score", match_score(F.lit(query), F.col("column"))).filter("score > 0").orderBy(F.col("score").desc(), "model", "column")
