"""Documents as ordered sections: parsers per format, slugs, ids, hashes, references and tags."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import TAG, URL

#: (title, level, first line, text lines): what a parser yields; level 0 is text before any heading.
Heading = tuple[str, int, int]
SECTION = (
    "path string, position int, section_id string, title string, level int, slug string, parent_position int, byte_start long, byte_end long, content_hash string, refs array<string>, tags array<string>, body_text string"
)
BODY_CHARS = 500


def slugify(title: str) -> str:
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", plain)).strip("-") or "section"


def markdown(text: str) -> list[Heading]:
    """ATX and setext headings outside fences."""
    found, fence, lines = [], None, text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r" {0,3}(`{3,}|~{3,})", line):
            fence = m[1] if fence is None else None if m[1][0] == fence[0] and len(m[1]) >= len(fence) else fence
        elif fence is None:
            if m := re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
                found.append((m[2], len(m[1]), i))
            elif i and lines[i - 1].strip() and re.match(r"(=+|-+)\s*$", line) and not lines[i - 1].lstrip().startswith(("#", "-", "*", ">")):
                found.append((lines[i - 1].strip(), 1 if line[0] == "=" else 2, i - 1))
    return found


def rst(text: str) -> list[Heading]:
    """Titles under (or between) adornment lines; levels by first use of the adornment."""
    lines, levels, found, i = text.split("\n"), [], [], 0
    mark = re.compile(r"([=\-`:'\"~^_*+#<>.])\1{2,}\s*$")
    while i + 1 < len(lines):
        over = bool(mark.match(lines[i])) and i + 2 < len(lines) and bool(mark.match(lines[i + 2])) and lines[i + 2][0] == lines[i][0] and lines[i + 1].strip()
        title = lines[i + 1] if over else lines[i]
        if over or (title.strip() and not mark.match(title) and mark.match(lines[i + 1]) and len(lines[i + 1].rstrip()) >= len(title.rstrip())):
            style = (lines[i][0] if over else lines[i + 1][0], bool(over))
            if style not in levels:
                levels.append(style)
            found.append((title.strip(), levels.index(style) + 1, i))
            i += 3 if over else 2
        else:
            i += 1
    return found


def asciidoc(text: str) -> list[Heading]:
    found, block = [], None
    for i, line in enumerate(text.split("\n")):
        if re.match(r"(-{4,}|={4,}|\.{4,}|\*{4,})\s*$", line):
            block = None if block == line.strip() else block or line.strip()
        elif block is None and (m := re.match(r"(={1,6})\s+(\S.*?)\s*$", line)):
            found.append((m[2], len(m[1]), i))
    return found


def plain(text: str) -> list[Heading]:
    """Paragraphs after blank lines, titled by their first words."""
    lines = text.split("\n")
    return [(line.strip()[:60], 1, i) for i, line in enumerate(lines) if line.strip() and (i == 0 or not lines[i - 1].strip())]


class _Markdown(HTMLParser):
    """HTML as Markdown-like text: headings, paragraphs, list items, links; scripts and styles go."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden, self.href = 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "pre", "blockquote"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag == "a":
            self.href = dict(attrs).get("href") or ""
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch(r"h[1-6]", tag) or tag == "p":
            self.out.append("\n\n")
        elif tag == "a":
            self.out.append(f"]({self.href})")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(text: str) -> str:
    p = _Markdown()
    p.feed(text)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def notebook_text(text: str) -> str:
    """Markdown cells as they are, code cells in fences of the kernel's language."""
    data = json.loads(text)
    language = data.get("metadata", {}).get("kernelspec", {}).get("language", "python")
    parts = []
    for cell in data.get("cells", []):
        source = "".join(cell.get("source", []))
        parts.append(source if cell.get("cell_type") == "markdown" else f"```{language}\n{source}\n```")
    return "\n\n".join(parts)


def _outline(value, level: int = 1) -> Iterator[str]:
    """Keys as headings, leaves as text."""
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in pairs:
        if isinstance(v, (dict, list)) and v and level <= 6:
            yield f"{'#' * level} {k}"
            yield from _outline(v, level + 1)
        else:
            yield f"{k}: {json.dumps(v, ensure_ascii=False)}"


def json_text(text: str) -> str:
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    data = json.loads(re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))
    if isinstance(data, dict) and ("openapi" in data or "swagger" in data) and "paths" in data:
        return openapi_text(data)
    return "\n".join(_outline(data))


def openapi_text(spec: dict) -> str:
    info = spec.get("info", {})
    out = [f"# {info.get('title', 'API')} {info.get('version', '')}".rstrip(), info.get("description", "")]
    for path, ops in spec["paths"].items():
        for verb, op in ops.items():
            if not isinstance(op, dict):
                continue
            out += [f"## {verb.upper()} {path}", op.get("summary") or op.get("description") or ""]
            out += [f"- {p.get('name')} ({p.get('in')})" for p in op.get("parameters", [])]
            out += [f"- {code}: {r.get('description', '')}" for code, r in op.get("responses", {}).items() if isinstance(r, dict)]
    return "\n".join(out)


def xml_text(text: str) -> str:
    def walk(node: ET.Element, level: int) -> Iterator[str]:
        tag = node.tag.rpartition("}")[2]
        own = (node.text or "").strip()
        if len(node) and level <= 6:
            yield f"{'#' * level} {node.get('name') or node.get('id') or tag}"
            if own:
                yield own
            for child in node:
                yield from walk(child, level + 1)
        else:
            yield f"{tag}: {' '.join(node.itertext()).strip()}"

    return "\n".join(walk(ET.fromstring(text), 1))


def yaml_text(text: str) -> str:
    """Keys that open a block become headings by indentation; the rest stays text."""
    out, widths = [], []
    for line in text.split("\n"):
        if m := re.match(r"(\s*)([\w./-]+):\s*(#.*)?$", line):
            widths = [w for w in widths if w < len(m[1])] + [len(m[1])]
            out.append(f"{'#' * min(6, len(widths))} {m[2]}")
        else:
            out.append(line)
    return "\n".join(out)


def _same(text: str) -> str:
    return text


#: Extension -> (to text, headings of it).  ``register`` adds one.
FORMATS: dict[str, tuple[Callable[[str], str], Callable[[str], list[Heading]]]] = {
    **dict.fromkeys((".md", ".markdown"), (_same, markdown)),
    ".mdx": (lambda t: re.sub(r"(?m)^(import|export)\s.*$|<[A-Z][^>]*>|</[A-Z]\w*>", "", t), markdown),
    **dict.fromkeys((".html", ".htm"), (html_text, markdown)),
    ".rst": (_same, rst),
    **dict.fromkeys((".adoc", ".asciidoc"), (_same, asciidoc)),
    ".txt": (_same, plain),
    ".ipynb": (notebook_text, markdown),
    **dict.fromkeys((".json", ".jsonc"), (json_text, markdown)),
    **dict.fromkeys((".yaml", ".yml"), (yaml_text, markdown)),
    **dict.fromkeys((".xml", ".svg"), (xml_text, markdown)),
}


def register(extension: str, to_text: Callable[[str], str], headings: Callable[[str], list[Heading]] = markdown) -> None:
    FORMATS[extension] = (to_text, headings)


def parse(path: str, text: str, repo: str = "") -> list[dict]:
    """Section rows of one document; unreadable ones have none."""
    name = path.rpartition("/")[2]
    kind = FORMATS.get("." + name.rpartition(".")[2].lower())
    if kind is None:
        return []
    try:
        text = kind[0](text)
        heads = kind[1](text)
    except (ValueError, ET.ParseError, AttributeError, TypeError, RecursionError):
        return []
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line.encode()) + 1
    if not heads or heads[0][2] > 0 and any(x.strip() for x in lines[: heads[0][2]]):
        heads = [(name, 0, 0), *heads]
    rows, stack, used, total = [], [], set(), len(text.encode())
    for i, (title, level, line) in enumerate(heads):
        stop = heads[i + 1][2] if i + 1 < len(heads) else len(lines)
        body = "\n".join(lines[line:stop])
        while stack and stack[-1][0] >= level:
            stack.pop()
        parent = stack[-1][2] if stack else None
        slug = base = "/".join([*(s for _, s, _ in stack), slugify(title)])
        n = 2
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        used.add(slug)
        stack.append((level, slugify(title), i))
        rows.append(
            {
                "path": path, "position": i, "section_id": f"{repo}::{path}::{slug}#{level}", "title": title, "level": level, "slug": slug, "parent_position": parent,
                "byte_start": starts[line], "byte_end": starts[stop] if stop < len(lines) else total, "content_hash": hashlib.sha256(body.encode()).hexdigest(),
                "refs": list(dict.fromkeys(re.findall(URL, body))), "tags": list(dict.fromkeys(re.findall(TAG, body))), "body_text": body[:BODY_CHARS],
            }
        )
    return rows


def sections(files: DataFrame, repo: str = "") -> DataFrame:
    """``SECTION`` rows of ``files(path, content)``."""
    columns = [c.split()[0] for c in SECTION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["content"], strict=True) for r in parse(p, t or "", repo)]
            out = pd.DataFrame(rows, columns=columns)
            out["parent_position"] = out["parent_position"].astype("Int32")
            yield out

    return files.select("path", F.col("content").cast("string").alias("content")).mapInPandas(run, SECTION)
