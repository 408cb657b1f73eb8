"""Code as rows: symbols, imports, import candidates and call sites."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.complexity import cyclomatic, nesting, params

SYMBOL = (
    "path string, symbol_id string, name string, qualified_name string, kind string, language string, signature string, docstring string, decorators array<string>, parent_symbol_id string, "
    "line_start int, line_end int, byte_offset long, byte_length long, content_hash string, cyclomatic int, max_nesting int, param_count int"
)
IMPORT = "path string, specifier string, names array<string>, candidates array<string>"
CALL = "path string, caller_symbol_id string, callee string, line int"
#: Definitions of languages without a parser here: kind and a pattern whose group is the name.
PATTERNS = {
    "javascript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("constant", r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\s*=")),
    "typescript": (("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>")),
    "go": (("method", r"^func\s+\([^)]*\)\s+(\w+)"), ("function", r"^func\s+(\w+)"), ("type", r"^type\s+(\w+)\s"), ("constant", r"^const\s+(\w+)\s")),
    "java": (("class", r"^\s*(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("type", r"^\s*(?:public\s+)?(?:interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|type)\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)\s*:")),
    "php": (("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("type", r"^\s*(?:interface|trait)\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static)\s+)*function\s+(\w+)")),
    "ruby": (("class", r"^\s*class\s+(\w+)"), ("type", r"^\s*module\s+(\w+)"), ("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")),
    "c": (("type", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+(\w+)\s*\{"), ("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{]*\)\s*\{")),
    "csharp": (("class", r"^\s*(?:public\s+|internal\s+|static\s+|sealed\s+|abstract\s+)*class\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\],? ]+\s+(\w+)\s*\(")),
    "swift": (("class", r"^\s*(?:public\s+|final\s+)*class\s+(\w+)"), ("type", r"^\s*(?:public\s+)?(?:struct|enum|protocol)\s+(\w+)"), ("function", r"^\s*(?:public\s+|private\s+|static\s+)*func\s+(\w+)")),
}
_CSS = (("constant", r"^\s*(--[\w-]+)\s*:"), ("type", r"^\s*@keyframes\s+([\w-]+)"), ("class", r"^\s*([.#][A-Za-z_][\w-]*)[^{};]*\{"))
PATTERNS |= {
    "cpp": PATTERNS["c"],
    "vue": PATTERNS["javascript"],
    "css": _CSS,
    "scss": (("constant", r"^\s*(\$[\w-]+)\s*:"), ("function", r"^\s*@(?:mixin|function)\s+([\w-]+)"), ("template", r"^\s*(%[\w-]+)[^{};]*\{"), *_CSS),
    "less": (("constant", r"^\s*(@(?!media|import|keyframes|plugin)[\w-]+)\s*:"), ("function", r"^\s*(\.[\w-]+)\([^)]*\)\s*\{"), *_CSS),
    "stylus": (("constant", r"^\s*(\$?[\w-]+)\s*="), ("function", r"^\s*([\w-]+)\([^)]*\)\s*$"), ("class", r"^\s*([.#][A-Za-z_][\w-]*)\s*$")),
}
#: Import statements: a pattern whose first group is the specifier.
IMPORTS = {
    "javascript": r"(?:^\s*import\s+(?:[^'\";]*?\s+from\s+)?|^\s*export\s+[^'\";]*?\s+from\s+|\brequire\(\s*|\bimport\(\s*)['\"]([^'\"]+)['\"]",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"\s]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;",
    "rust": r"^\s*(?:pub\s+)?(?:use\s+([\w:]+)|mod\s+\w+;)",
    "php": r"^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"][^'\"]+['\"])",
    "ruby": r"^\s*(?:require|require_relative|load)\s+['\"]([^'\"]+)['\"]",
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "swift": r"^\s*import\s+(?:\w+\s+)?([\w.]+)",
    "scss": r"@(?:import|use|forward)\s+['\"]([^'\"]+)['\"]",
    "less": r"@import\s+(?:\([^)]*\)\s*)?['\"]([^'\"]+)['\"]",
    "stylus": r"^\s*@(?:import|require)\s+['\"]([^'\"]+)['\"]",
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "vue": IMPORTS["javascript"], "cpp": IMPORTS["c"]}


def _row(path: str, text: str, language: str, name: str, qualified: str, kind: str, first: int, last: int, signature: str, doc: str | None, decorators: list[str], parent: str | None, repo: str) -> dict:
    lines = text.split("\n")
    source = "\n".join(lines[first - 1 : last])
    offset = len("\n".join(lines[: first - 1]).encode()) + (1 if first > 1 else 0)
    body = source.encode()
    return {
        "path": path, "symbol_id": f"{repo}::{path}::{qualified}#{kind}", "name": name, "qualified_name": qualified, "kind": kind, "language": language, "signature": signature, "docstring": doc, "decorators": decorators,
        "parent_symbol_id": parent, "line_start": first, "line_end": last, "byte_offset": offset, "byte_length": len(body), "content_hash": hashlib.sha256(body).hexdigest(),
        "cyclomatic": cyclomatic(source, language), "max_nesting": nesting(source, language), "param_count": params(source, language) if kind in ("function", "method") else 0,
    }


def _python(path: str, text: str, repo: str) -> list[dict]:
    out: list[dict] = []

    def visit(body: list[ast.stmt], owner: str, parent: str | None, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(node, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                qualified = f"{owner}.{node.name}" if owner else node.name
                if is_class:
                    bases = ", ".join(ast.unparse(b) for b in node.bases)
                    signature = f"class {node.name}({bases})" if bases else f"class {node.name}"
                else:
                    signature = f"{'async ' * isinstance(node, ast.AsyncFunctionDef)}def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                decorators = ["@" + ast.unparse(d) for d in node.decorator_list]
                out.append(_row(path, text, "python", node.name, qualified, kind, node.lineno, node.end_lineno, signature, ast.get_docstring(node), decorators, parent, repo))
                visit(node.body, qualified, out[-1]["symbol_id"], is_class)
            elif isinstance(node, ast.Assign) and not owner:
                for t in node.targets:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        out.append(_row(path, text, "python", t.id, t.id, "constant", node.lineno, node.end_lineno, text.split("\n")[node.lineno - 1].strip()[:120], None, [], parent, repo))

    visit(ast.parse(text).body, "", None, False)
    return out


def _by_pattern(path: str, text: str, language: str, repo: str) -> list[dict]:
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        for kind, p in PATTERNS[language]:
            if m := re.match(p, line):
                found.append((i, kind, m[1], len(line) - len(line.lstrip()), line.strip().rstrip("{").strip()))
                break
    out, stack = [], []
    for n, (line, kind, name, indent, signature) in enumerate(found):
        last = next((f[0] - 1 for f in found[n + 1 :] if f[3] <= indent), len(lines))
        while last > line and not lines[last - 1].strip():
            last -= 1
        stack = [s for s in stack if s[0] < indent and s[3] >= line]
        owner = stack[-1] if stack else None
        if owner and owner[2] in ("class", "type") and kind == "function":
            kind = "method"
        qualified = f"{owner[1]}.{name}" if owner else name
        out.append(_row(path, text, language, name, qualified, kind, line, last, signature[:200], None, [], owner[4] if owner else None, repo))
        if kind in ("class", "type"):
            stack.append((indent, qualified, kind, last, out[-1]["symbol_id"]))
    return out


def _package_json(path: str, text: str, repo: str) -> list[dict]:
    """Scripts are functions, dependencies constants, each at the line that names it."""
    data, lines = json.loads(text), text.split("\n")
    out = []
    for part, kind in (("scripts", "function"), ("dependencies", "constant"), ("devDependencies", "constant"), ("peerDependencies", "constant")):
        start = next((i for i, line in enumerate(lines) if f'"{part}"' in line), 0)
        for name, value in (data.get(part) or {}).items():
            at = next((i for i in range(start, len(lines)) if json.dumps(name) in lines[i]), start)
            out.append(_row(path, text, "json", name, f"{part}.{name}", kind, at + 1, at + 1, f"{name}: {value}"[:200], None, [], None, repo))
    return out


def _kubernetes(path: str, text: str, repo: str) -> list[dict]:
    """A symbol for each object of a manifest: its kind and name; a Secret's values are no part of it."""
    out, first = [], 1
    for part in re.split(r"(?m)^---\s*$", text):
        size = part.count("\n")
        kind, name = re.search(r"(?m)^kind:\s*(\w+)", part), re.search(r"(?ms)^metadata:\s*\n(?:[ \t]+[^\n]*\n)*?[ \t]+name:\s*[\"']?([\w.-]+)", part)
        if kind and name and re.search(r"(?m)^apiVersion:", part):
            space = re.search(r"(?m)^[ \t]+namespace:\s*[\"']?([\w.-]+)", part)
            qualified = f"{space[1]}/{kind[1]}/{name[1]}" if space else f"{kind[1]}/{name[1]}"
            lead = len(part) - len(part.lstrip("\n"))
            out.append(_row(path, text, "yaml", name[1], qualified, "type", first + lead, max(first + lead, first + size - (1 if part.endswith("\n") else 0)), f"{kind[1]} {name[1]}", None, [], None, repo))
        first += size
    return out


def without_secrets(text: str) -> str:
    """A manifest's text with the values of its Secrets replaced by ``***``."""
    parts = re.split(r"(?m)^(---\s*)$", text)
    for i, part in enumerate(parts):
        if re.search(r"(?m)^kind:\s*Secret\b", part):
            parts[i] = re.sub(r"(?m)^(data|stringData):[ \t]*\n((?:[ \t]+[^\n]*(?:\n|$))+)", lambda m: f"{m[1]}:\n" + re.sub(r"(?m)^([ \t]+[\w.-]+:)[^\n]*(?:\n(?=[ \t]{4,})[^\n]*)*", r"\1 ***", m[2]), part)
    return "".join(parts)


def symbols_of(path: str, text: str, language: str, repo: str = "") -> list[dict]:
    """Symbol rows of one file; repeated ids get ``~1``, ``~2`` behind; a file that doesn't parse has none."""
    try:
        if language == "python":
            rows = _python(path, text, repo)
        elif language == "json":
            rows = _package_json(path, text, repo) if path.endswith("package.json") else []
        elif language == "yaml":
            rows = _kubernetes(path, text, repo) if "apiVersion:" in text else []
        else:
            rows = _by_pattern(path, text, language, repo) if language in PATTERNS else []
    except (SyntaxError, ValueError, AttributeError, RecursionError):
        return []
    seen: dict[str, int] = {}
    for r in rows:
        n = seen[r["symbol_id"]] = seen.get(r["symbol_id"], -1) + 1
        if n:
            r["symbol_id"] += f"~{n}"
    return rows


def candidates(specifier: str, path: str, language: str, roots: tuple[str, ...] = ("", "src/")) -> list[str]:
    """Paths that an import may mean, likeliest first."""
    here = path.rpartition("/")[0]
    if language == "python":
        dots = len(specifier) - len(specifier.lstrip("."))
        module = specifier.lstrip(".").replace(".", "/")
        if dots:
            base = "/".join(here.split("/")[: len(here.split("/")) - (dots - 1)]) if here else ""
            bases = [f"{base}/" if base else ""]
        else:
            bases = list(roots)
        return [x for b in bases for x in ([f"{b}{module}.py", f"{b}{module}/__init__.py"] if module else [f"{b}__init__.py"])]
    if language in ("javascript", "typescript", "vue") and specifier.startswith("."):
        parts = [p for p in here.split("/") if p]
        for p in specifier.split("/"):
            parts = parts[:-1] if p == ".." else parts if p in (".", "") else [*parts, p]
        base = "/".join(parts)
        return [base] * bool(re.search(r"\.\w+$", base)) + [base + e for e in (".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.js")]
    if language == "java":
        return [f"{r}{specifier.replace('.', '/')}.java" for r in ("", "src/main/java/", "src/")]
    if language in ("c", "cpp"):
        return [f"{here}/{specifier}" if here else specifier, specifier, f"include/{specifier}", f"src/{specifier}"]
    if language == "ruby":
        return [f"{r}{specifier}.rb" for r in (f"{here}/" if here else "", "lib/", "")]
    if language == "rust":
        parts = [p for p in specifier.split("::") if p not in ("crate", "self", "super")]
        return [f"src/{'/'.join(parts[:n])}{e}" for n in range(len(parts), 0, -1) for e in (".rs", "/mod.rs")]
    if language == "php":
        tail = specifier.split("\\")
        return [f"{r}{'/'.join(tail[i:])}.php" for i in range(len(tail)) for r in ("src/", "app/", "")]
    if language in ("scss", "less", "stylus"):
        folder, _, name = specifier.rpartition("/")
        at = "/".join(p for p in (here, folder) if p)
        ext = {"scss": ".scss", "less": ".less", "stylus": ".styl"}[language]
        return [f"{at}/{n}{ext}".lstrip("/") for n in (name, f"_{name}")]
    return []


def imports_of(path: str, text: str, language: str) -> list[dict]:
    found: list[tuple[str, list[str]]] = []
    if language == "python":
        try:
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, ast.Import):
                    found += [(a.name, []) for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    found.append(("." * node.level + (node.module or ""), [a.name for a in node.names]))
        except (SyntaxError, ValueError):
            return []
    elif language in IMPORTS:
        found = [(s, []) for s in re.findall(IMPORTS[language], text, re.M) if s]
    return [{"path": path, "specifier": s, "names": names, "candidates": candidates(s, path, language)} for s, names in found]


def calls_of(path: str, text: str, repo: str = "") -> list[dict]:
    """Call sites of a Python file with their innermost enclosing symbol; at module level the caller is ``__module__``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    own = symbols_of(path, text, "python", repo)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and re.fullmatch(r"[\w.]+", callee := ast.unparse(node.func)):
            around = [s for s in own if s["kind"] in ("function", "method") and s["line_start"] <= node.lineno <= s["line_end"]]
            caller = max(around, key=lambda s: s["line_start"])["symbol_id"] if around else "__module__"
            out.append({"path": path, "caller_symbol_id": caller, "callee": callee, "line": node.lineno})
    return sorted(out, key=lambda r: (r["line"], r["callee"]))


def _each(files: DataFrame, schema: str, rows_of) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t, g in zip(pdf["path"], pdf["content"], pdf["language"], strict=True) for r in rows_of(p, t or "", g)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", F.col("content").cast("string").alias("content"), "language").filter(F.col("language").isNotNull()).mapInPandas(run, schema)


def symbols(files: DataFrame, repo: str = "") -> DataFrame:
    """``SYMBOL`` rows of ``files(path, language, content)``."""
    return _each(files, SYMBOL, lambda p, t, g: symbols_of(p, t, g, repo))


def imports(files: DataFrame) -> DataFrame:
    return _each(files, IMPORT, imports_of)


def calls(files: DataFrame, repo: str = "") -> DataFrame:
    return _each(files.filter(F.col("language") == "python"), CALL, lambda p, t, g: calls_of(p, t, repo))
