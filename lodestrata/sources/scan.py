"""Scans of file trees, and the order in which files are turned away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename

# Folders, endings and names that are never read.
SKIPPED_DIRS = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build", ".tox", ".mypy_cache", "target", "vendor")
BINARY_ENDINGS = "png jpg jpeg gif ico pdf zip gz tar jar class so dll exe bin woff woff2 ttf mp3 mp4 pyc".split()
SECRET_NAMES = r"(?i)^(?:\.env(?:\..*)?|id_rsa.*|.*\.pem|.*\.key|.*\.p12|credentials(?:\..*)?)$"
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "rb": "ruby",
    "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "sql": "sql", "sh": "bash", "kt": "kotlin", "scala": "scala", "lua": "lua",
    "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "css": "css", "proto": "proto", "tf": "hcl",
}


def scan_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (relative to the root), size_bytes, mtime, content of all files below a folder. Reads no content that is not asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return _relative(rows, root)


def scan_paths(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """The same for the paths given."""
    return _relative(spark.read.format("binaryFile").load([f"{root.rstrip('/')}/{p}" for p in paths]), root)


def _relative(rows: DataFrame, root: str) -> DataFrame:
    tail = F.element_at(F.split("path", F.lit(r"\Q" + root.rstrip("/") + r"/\E")), -1)
    return rows.select(tail.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "content")


def ignore_regex(rule: str) -> tuple[str, bool]:
    """The regex over relative paths of one ignore rule, and whether it takes files back in.

    A rule with a slash inside is bound to the root; a trailing slash means folders; what lies below an
    ignored folder is ignored.
    """
    back = rule.startswith("!")
    body = rule.lstrip("!").strip()
    folder, bound = body.endswith("/"), "/" in body.rstrip("/")
    out = ""
    for part in _pieces(body.strip("/")):
        out += part
    return ("^" if bound else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), back


def _pieces(glob: str) -> list[str]:
    import re

    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return out


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether a path is ignored: of the rules that fit it the last one holds."""
    out = F.lit(False)
    for rule in rules:
        if rule.strip() and not rule.startswith("#"):
            pattern, back = ignore_regex(rule.strip())
            out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def admission(path: Column, size: Column, rules: Sequence[str] = (), largest: int = 500 * 1024) -> Column:
    """Why a file is turned away, by the first reason in order; null for one that is read."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(path.isNull(), "no_path")
        .when(path.rlike("(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"), "skipped_dir")
        .when(ignored(path, rules), "ignored")
        .when(basename(path).rlike(SECRET_NAMES), "secret")
        .when(ending.isin(BINARY_ENDINGS), "binary")
        .when(~ending.isin(list(LANGUAGES)), "unknown_language")
        .when(size.isNull() | (size > largest), "too_large")
    )


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))]


def skip_counts(df: DataFrame, reason: str) -> DataFrame:
    """reason, files: how many files each reason turned away."""
    return df.groupBy(F.coalesce(reason, F.lit("read")).alias("reason")).agg(F.count("*").alias("files"))
