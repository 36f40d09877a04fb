"""What a project says of itself: records of its build and run files, members of workspaces, audits of notes to tools.

Only files whose base name says that they are such files pass through Python, whole and batch by batch; a file
that cannot be read as what it should be gives no records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, glob_match

# Base names of the files that are read, by what they are.
KINDS = {
    "container": r"^Dockerfile(?:\..+)?$|^Containerfile$|\.dockerfile$",
    "compose": r"^(?:docker-)?compose(?:\.[\w\-]+)?\.ya?ml$",
    "pipeline": r"^\.gitlab-ci\.ya?ml$|^azure-pipelines\.ya?ml$|^Jenkinsfile$|^workflow[\w\-]*\.ya?ml$|^ci\.ya?ml$",
    "environment": r"^\.env(?:\..+)?$",
    "scripts": r"^package\.json$",
    "targets": r"^(?:GNU)?[Mm]akefile$",
}
_STEP = re.compile(r"^\s*(FROM|EXPOSE|ENV|ARG|ENTRYPOINT|CMD|COPY|VOLUME)\s+(.+?)\s*$", re.I | re.M)
_VARIABLE = re.compile(r"^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", re.M)
_TARGET = re.compile(r"^([\w.\-/]+)\s*:(?!=)", re.M)
_FIELD = re.compile(r"^\s*-?\s*(image|build|uses|run|script|stage|command|context|dockerfile)\s*:\s*['\"]?([^'\"\n#]+?)['\"]?\s*$", re.M)


def _records(kind: str, text: str) -> list[tuple[str, str]]:
    if kind == "container":
        return [(k.upper(), v) for k, v in _STEP.findall(text)]
    if kind == "environment":  # names alone: values may be secret
        return [("variable", k) for k in _VARIABLE.findall(text)]
    if kind == "targets":
        return [("target", k) for k in _TARGET.findall(text) if not k.startswith(".")]
    if kind == "scripts":
        try:
            found = json.loads(text).get("scripts")
        except (ValueError, AttributeError):
            return []
        return [(str(k), str(v)) for k, v in found.items()] if isinstance(found, dict) else []
    return _FIELD.findall(text)


def kind_of(path: Column) -> Column:
    """What kind of project file a path is; null for none."""
    base, out = basename(path), None
    for kind, pattern in KINDS.items():
        out = F.when(base.rlike(pattern), kind) if out is None else out.when(base.rlike(pattern), kind)
    return out.when(path.rlike(r"(?:^|/)\.github/workflows/[^/]+\.ya?ml$"), "pipeline")


def project_records(texts: DataFrame) -> DataFrame:
    """path, kind, key, value of the build and run files among ``texts`` (path, content); repeated rows count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, kind, k, v) for p, kind, t in zip(b["path"], b["kind"], b["content"], strict=True) for k, v in _records(kind, t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "key", "value"])

    files = texts.select("path", kind_of(F.col("path")).alias("kind"), "content").where("kind is not null and content is not null")
    return files.mapInPandas(run, "path string, kind string, key string, value string").distinct()


def file_references(records: DataFrame, files: DataFrame) -> DataFrame:
    """path, key, file: the files that records (path, key, value) name, by their path or the end of it.

    Both sides meet on the base name; a word is a file's name if the file's path is it or ends in it behind a slash.
    """
    words = records.select("path", "key", F.explode(F.split("value", r"[\s,;:='\"()\[\]]+")).alias("word"))
    asked = words.select("path", "key", F.regexp_replace("word", r"^(?:\./)+", "").alias("word")).where(F.col("word").rlike(r"\w\.\w+$")).distinct()
    known = files.select(F.col("path").alias("file")).where("file is not null").distinct()
    j = asked.withColumn("base", basename(F.col("word"))).join(known.withColumn("base", basename(F.col("file"))), "base")
    return j.where((F.col("file") == F.col("word")) | F.col("file").endswith(F.concat(F.lit("/"), F.col("word")))).select("path", "key", "file").distinct()


def _member_globs(path: str, text: str) -> list[str]:
    base = path.rpartition("/")[2]
    if base == "package.json":
        try:
            found = json.loads(text).get("workspaces")
        except (ValueError, AttributeError):
            return []
        found = found.get("packages") if isinstance(found, dict) else found
        return [str(x) for x in found] if isinstance(found, list) else []
    if base == "pnpm-workspace.yaml":
        part = re.search(r"^packages:\s*\n((?:\s+-.*\n?)+)", text, re.M)
        return re.findall(r"-\s*['\"]?([^'\"\n]+?)['\"]?\s*$", part[1], re.M) if part else []
    if base == "Cargo.toml":
        part = re.search(r"^\[workspace\][^\[]*?\bmembers\s*=\s*\[([^\]]*)\]", text, re.M)
        return re.findall(r"['\"]([^'\"]+)['\"]", part[1]) if part else []
    part = re.search(r"^use\s*\(([^)]*)\)", text, re.M)
    return [x.strip() for x in part[1].splitlines() if x.strip()] if part else re.findall(r"^use\s+(\S+)\s*$", text, re.M)


def workspaces(texts: DataFrame) -> DataFrame:
    """root, glob: the members that the manifests among ``texts`` (path, content) declare, below the manifest's directory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p.rpartition("/")[0], g.removeprefix("./").rstrip("/")) for p, t in zip(b["path"], b["content"], strict=True) for g in _member_globs(p, t) if not g.startswith("!")]
            yield pd.DataFrame(rows, columns=["root", "glob"])

    manifests = texts.select("path", "content").where(F.col("path").rlike(r"(?:^|/)(?:package\.json|pnpm-workspace\.yaml|Cargo\.toml|go\.work)$") & F.col("content").isNotNull())
    return manifests.mapInPandas(run, "root string, glob string").distinct()


def member_of(files: DataFrame, declared: DataFrame) -> DataFrame:
    """path, member: the deepest declared directory above each file; a glob's last part may be *.

    Every directory above a file asks for itself and for its parent's *, so globs meet paths by an equi-join.
    """
    parts = F.split(dirname(F.col("path")), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), F.concat_ws("/", F.when(i > 1, F.array_join(F.slice(parts, 1, i - 1), "/")), F.lit("*")).alias("star"), i.alias("depth")))
    each = files.select("path").where("path is not null").distinct().select("path", F.explode(ups).alias("u")).select("path", "u.dir", "u.depth", F.explode(F.array("u.dir", "u.star")).alias("full"))
    globs = declared.select(F.regexp_replace(F.when(F.col("root") == "", F.col("glob")).otherwise(F.concat_ws("/", "root", "glob")), r"/\*\*$", "/*").alias("full")).distinct()
    return each.join(globs, "full").groupBy("path").agg(F.max_by("dir", "depth").alias("member"))


def config_audit(texts: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """path, tokens, repeated, stale of the notes to tools among ``texts``, told by globs of their names: tokens at four
    characters each, lines that another note has as well, and paths in back quotes that no file has."""
    wanted = None
    for g in names:
        wanted = glob_match(F.col("path"), g) if wanted is None else wanted | glob_match(F.col("path"), g)
    notes = texts.select("path", "content").where(wanted & F.col("content").isNotNull()).distinct()
    rows = notes.select("path", F.explode(F.split("content", "\n")).alias("l")).select("path", F.trim("l").alias("l")).where("length(l) >= 12").distinct()
    twice = rows.groupBy("l").agg(F.count("*").alias("n")).where("n > 1")
    repeated = rows.join(twice, "l").groupBy("path").agg(F.count("*").alias("repeated"))
    named = notes.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"`([\w.\-]+(?:/[\w.\-]+)+)`"), 1)).alias("file")).distinct()
    stale = named.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_anti").groupBy("path").agg(F.count("*").alias("stale"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = notes.select("path", F.expr("length(content) div 4").alias("tokens"))
    return sized.join(repeated, "path", "left").join(stale, "path", "left").select("path", "tokens", zero("repeated"), zero("stale"))
