"""Source trees as rows: discovery, exclusion, incremental scans and content-addressed storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.operators.predicates import glob_pattern

MOST_FILES, MOST_BYTES, HEAD_BYTES = 5_000, 512_000, 8_192
#: Directories and files that a scan leaves out.
SKIP_DIRS = (
    "node_modules", "vendor", ".git", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "build", "dist", ".gradle", ".mvn",
    ".next", ".nuxt", ".output", ".vercel", ".turbo", "venv", ".venv", "env", ".env", ".idea", ".vscode", ".vs", "coverage", "htmlcov", ".nyc_output",
    ".terraform", ".pulumi", "Pods", "DerivedData", "xcuserdata", ".bundle", ".cache",
)
SKIP_FILES = (
    "*.min.js", "*.min.css", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "uv.lock", "*.pb.go",
    "*.generated.*", "*.pyc", "*.pyo",
)
SECRET_FILES = (
    ".env", ".env.*", "*.key", "*.pem", "*.p12", "*.pfx", "*.keystore", "*.jks", "credentials.json", "service-account*.json", "id_rsa", "id_rsa.*",
    "id_ed25519", "id_ed25519.*", "*.secret", "*.secrets", ".htpasswd", ".netrc", ".pgpass",
)
BINARY_EXTENSIONS = (
    ".exe", ".dll", ".so", ".dylib", ".a", ".lib", ".o", ".obj", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".png", ".jpg", ".jpeg",
    ".gif", ".bmp", ".ico", ".svg", ".webp", ".tiff", ".tif", ".psd", ".mp3", ".mp4", ".avi", ".mov", ".flv", ".wmv", ".wav", ".ogg", ".webm", ".pyc", ".pyo",
    ".class", ".wasm", ".ttf", ".otf", ".woff", ".woff2", ".eot", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3",
    ".mdb", ".bin", ".dat", ".pkl", ".npy", ".npz", ".h5", ".hdf5",
)
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "php": "php", "rb": "ruby",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "sql": "sql", "css": "css", "scss": "scss", "less": "less", "styl": "stylus", "vue": "vue",
    "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml", "md": "markdown", "html": "html",
}


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, byte_size, mtime, content)`` of the files below a folder of any Hadoop file system; paths are relative.

    Spark's reader itself passes over empty files and names that begin with a dot or underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    top = root.split("://")[-1].rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), top, -1)
    return reader.load(root).select(relative.alias("path"), F.col("length").alias("byte_size"), F.col("modificationTime").cast("double").alias("mtime"), "content")


def _any_glob(name: Column, globs: tuple[str, ...]) -> Column:
    return name.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def skip_reason(path: Column, byte_size: Column, content: Column | None = None, most_bytes: int = MOST_BYTES) -> Column:
    """Why a scan leaves a file out, or null."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    inside = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    out = (
        F.when(path.rlike(r"(^|/)\.\.(/|$)"), "path_traversal")
        .when(F.exists(inside, lambda d: d.isin(*SKIP_DIRS)), "skip_dir")
        .when(_any_glob(name, SKIP_FILES), "skip_pattern")
        .when(_any_glob(F.lower(name), SECRET_FILES), "secret_file")
        .when(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*BINARY_EXTENSIONS), "binary_extension")
        .when(byte_size > most_bytes, F.concat(F.lit("too_large:"), byte_size.cast("string")))
        .when(byte_size == 0, "empty")
    )
    return out if content is None else out.when(F.contains(F.hex(F.substring(content, 1, HEAD_BYTES)), F.lit("00")) & (F.instr(F.decode(F.substring(content, 1, HEAD_BYTES), "iso-8859-1"), "\0") > 0), "binary_content")


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def discover(tree: DataFrame, most_files: int | None = None, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files to index, in path order up to ``most_files`` (a setting of the scan), and the left-out ones by reason."""
    judged = tree.withColumn("skip_reason", skip_reason(F.col("path"), F.col("byte_size"), F.col("content") if "content" in tree.columns else None, most_bytes))
    kept = judged.filter("skip_reason IS NULL").drop("skip_reason").withColumns({"language": language_of(F.col("path")), "content_hash": F.sha2("content", 256)} if "content" in tree.columns else {"language": language_of(F.col("path"))})
    kept = kept if most_files is None else kept.orderBy("path").limit(most_files)
    return kept, judged.filter("skip_reason IS NOT NULL").groupBy(F.substring_index("skip_reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or whose content hash differs."""
    return current.join(stored.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def purge(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored rows whose path still exists."""
    return stored.join(current.select("path"), "path", "left_semi")


def store_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """Content by hash, each once; known hashes stay as they are."""
    new = files.select("content_hash", "content").dropDuplicates(["content_hash"]).join(blobs, "content_hash", "left_anti")
    return blobs.unionByName(new)


def reconcile(disk: DataFrame, table: DataFrame, key: str = "name") -> DataFrame:
    """``(key, status)``: ok, missing_on_disk or not_indexed."""
    a, b = disk.select(key).distinct().withColumn("_d", F.lit(True)), table.select(key).distinct().withColumn("_t", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_d").isNull(), "missing_on_disk").when(F.col("_t").isNull(), "not_indexed").otherwise("ok").alias("status"))


def log_tail(spark: SparkSession, path: str, lines: int = 50, from_start: bool = False, offset: int = 0) -> DataFrame:
    """``(line_no, line)``: a page of a log file from its start or end."""
    # the reader splits a large file between tasks; ids of rows follow tasks and lines, and the lines of each task are counted once
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    part = F.shiftright("id", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a task
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    page = rows.orderBy(F.col("id").asc() if from_start else F.col("id").desc()).offset(offset).limit(lines)
    numbered = page.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.select((F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line_no"), "line").orderBy("line_no")


def commit_log(lines: DataFrame) -> DataFrame:
    """``(commit_hash, author, ts, message)`` of ``value`` rows ``hash|author|iso time|message``."""
    p = F.split("value", r"\|", 4)
    return lines.select(p[0].alias("commit_hash"), p[1].alias("author"), p[2].cast("timestamp").alias("ts"), p[3].alias("message"))


def blame_lines(lines: DataFrame) -> DataFrame:
    """``(path, line, commit_hash, author, ts)`` of porcelain blame rows ``(path, n, value)``, ``n`` the row's number in its path's output.

    A group begins with ``hash old new [size]``; its author and time follow, at least once for each commit, and a tab leads the line itself.
    """
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("commit_hash", F.last(F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 1)), ignorenulls=True).over(w))
    marked = marked.withColumn("line", F.last(F.when(F.col("value").rlike(head), F.regexp_extract("value", head, 2).cast("int")), ignorenulls=True).over(w))
    said = marked.groupBy("path", "commit_hash").agg(
        F.max(F.when(F.col("value").startswith("author "), F.substring("value", 8, 1 << 20))).alias("author"), F.max(F.when(F.col("value").startswith("author-time "), F.substring_index("value", " ", -1).cast("long"))).alias("at")
    )
    own = marked.filter(F.col("value").startswith("\t")).select("path", "line", "commit_hash")
    return own.join(said, ["path", "commit_hash"]).select("path", "line", "commit_hash", "author", F.timestamp_seconds("at").alias("ts"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """``(path, old_start, old_lines, new_start, new_lines, added, removed)`` of unified diff rows ``(n, value)`` in order of ``n``; ``path`` is the new one."""
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one diff's text
    v = F.col("value")
    marked = lines.withColumns(
        {
            "path": F.last(F.when(v.rlike(r"^\+\+\+ "), F.regexp_replace(F.substring("value", 5, 1 << 20), "^b/", "")), ignorenulls=True).over(w),
            "_hunk": F.sum(F.when(v.rlike(hunk), 1).otherwise(0)).over(w),
            "_file": F.sum(F.when(v.startswith("diff --git ") | v.startswith("--- "), 1).otherwise(0)).over(w),
        }
    )
    first = F.first(F.when(v.rlike(hunk), v), ignorenulls=True)
    # the header's own lines stand behind a new file's mark, before its first hunk
    inside = marked.withColumn("_open", F.last(F.when(v.rlike(hunk), F.col("_file")), ignorenulls=True).over(w)).filter("_hunk > 0 AND _open = _file")
    got = inside.groupBy("_hunk").agg(F.first("path").alias("path"), first.alias("h"), F.count_if(v.startswith("+")).alias("added"), F.count_if(v.startswith("-")).alias("removed"))

    def number(i: int) -> Column:
        text = F.regexp_extract("h", hunk, i)
        return F.when(text == "", 1).otherwise(text.cast("int"))

    return got.select("path", number(1).alias("old_start"), number(2).alias("old_lines"), number(3).alias("new_start"), number(4).alias("new_lines"), "added", "removed").orderBy("path", "new_start")
