"""Source files that nobody wrote by hand for their repository.

A repository says which of its paths are generated or vendored in attribute files. Their globs are
resolved as the version control system does it: the file in the deepest directory wins, and in one file
the last line that matches. What several repositories declare is mined as directory names, base names and
suffixes, and holds, with a table of well-known ones, for repositories that declare nothing. Last come
marks in the text itself: a header comment, packed lines, or data in place of statements.

Texts and files are only joined on the path after each text has been reduced to one flag, so texts are
never shuffled. Only repositories with attribute files pass through Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that mark a directory as third-party or generated, wherever it stands in the path.
VENDORED_DIRS = (
    "vendor vendored _vendor third_party thirdparty third-party 3rdparty extern externals external Godeps node_modules "
    "bower_components site-packages dist-packages deps Pods Carthage jspm_packages"
).split()
GENERATED_DIRS = "generated __generated__ gen autogen codegen-out generated-sources generated_sources _generated".split()
# Base names that a generator or a packer gives its output. {} stands for an extension.
GENERATED_NAMES = (
    r".+\.(?:gen|g|generated|designer|pb|pb\.gw|pb\.cc|pb\.h|freezed)\.\w+",
    r".+_(?:gen|generated|pb2|pb2_grpc|pb|grpc_pb)\.\w+",
    r"zz_generated[_.].*",
    r".+[.\-](?:min|bundle|packed|chunk)\.(?:js|ts|css|mjs|cjs)",
    r"\w+[.\-][0-9a-f]{8,}\.(?:js|ts|css|mjs)",
)
# What a generator writes at the head of its output.
GENERATED_HEADS = (
    r"@generated\b",
    r"<auto-?generated",
    r"\bcode generated by\b",
    r"\bauto-?generated\b[^\n]*\b(?:edits?|changes?|do not|don't|lost|by the|by \S+ \d|from)\b",
    r"\bautomatically generated\b[^\n]*\b(?:from|by)\b[^\n]*\b(?:change|edit|modify)",
    r"\bthis file (?:was|is|has been) (?:automatically |auto-?)?generated\b",
    r"\bgenerated file\b[^\n]*\bsource\b",
    r"\bderived file\b",
    r"\bdo not (?:modify|edit|change|touch)\b[^\n]*\b(?:written|generated|produced|created|built|made) by\b",
    r"\bmachine-(?:made|generated|written)\b",
    r"\bregenerate instead of\b",
    r"\boutput of \S+[^\n]*\bchanges? belongs?\b",
    r"\bproduced by tool\b",
    r"\bemitted from \S+\.\w+",
)
# What stands at the head of a file taken from elsewhere.
VENDORED_HEADS = (
    r"\bcopied (?:verbatim )?from \S+ v?\d",
    r"\bkeep in sync with upstream\b",
    r"\bupstream file\b",
    r"\bimported verbatim from\b",
    r"\bvendored copy of\b",
    r"\bbundled with us because\b",
    r"\(c\) the \S+ contributors\b",
    r"\bpart of \S+\. licen[cs]e: see\b",
    r"(?m)^\s*(?:#|//|/\*!?|\*|--)\s*[\w.\-]+ v?\d+\.\d+(?:\.\d+)?\s*(?:\*/)?\s*$",
)
# How a line begins that declares a function or type, gives a value back or stores what a call gives.
CODE_LINE = r"(?m)^[^\S\n]*+(?:(?:(?:export|async|public|private|protected|static)[^\S\n]++)*+(?:def|func|function|class|type|interface|struct|enum|impl|fn)\b|return\b|(?:(?:const|let|var|final)[^\S\n]++)?\w++[^\S\n]*+:?=[^\S\n]*+\w++\()"
# The attributes that mark a path, and what a marked file is.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}


def _segment(names: list[str]) -> str:
    return "(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + ")/"


def path_mark(path: Column) -> Column:
    """'vendored', 'generated' or null, from the names in a path alone. The repository's name is no directory."""
    inner = F.regexp_replace(path, r"^[^/]*/", "")
    return (
        F.when(inner.rlike(_segment(VENDORED_DIRS)), "vendored")
        .when(inner.rlike(_segment(GENERATED_DIRS)), "generated")
        .when(F.regexp_extract(path, r"[^/]*$", 0).rlike("^(?:" + "|".join(GENERATED_NAMES) + ")$"), "generated")
    )


def text_mark(text: Column, long_line: int = 400, packed_share: float = 0.12, digit_share: float = 0.22) -> Column:
    """'generated', 'vendored', 'minified', 'data' or null, from a text.

    A header is the comment lines that begin the text, four at most. Minified text has lines of
    ``long_line`` characters on average and next to no blanks (below ``packed_share``). Data are runs of
    encoded bytes, or text of which ``digit_share`` are digits and at most one line in 20 is code: a table of
    numbers next to a type or function somebody wrote is none. A null or empty text has no mark.
    """
    head = F.regexp_extract(text, r"\A\x{feff}?(?:[^\S\n]*(?:#|//|/\*|\*|--|<!--|;|%)[^\n]*(?:\n|\z)){1,4}", 0)
    size = F.length(text)
    lines = F.length(F.regexp_replace(text, r"[^\n]+", "")) + 1
    digits = F.length(F.regexp_replace(text, r"[^0-9]+", ""))
    blanks = F.length(F.regexp_replace(text, r"[^ \t\n]+", ""))
    names = F.regexp_replace(F.regexp_replace(text, r"\d+", "0"), r"[A-Za-z_]+", "w")
    return (
        F.when(text.isNull() | (size == 0), None)
        .when(head.rlike("(?i)" + "|".join(f"(?:{p})" for p in GENERATED_HEADS)), "generated")
        .when(head.rlike("(?i)" + "|".join(f"(?:{p})" for p in VENDORED_HEADS)), "vendored")
        .when((size >= 200) & text.rlike(r"[A-Za-z0-9+/=_\-]{300,}"), "data")
        .when((size >= 200) & (digits / size >= digit_share) & (F.regexp_count(text, F.lit(CODE_LINE)) * 20 <= lines), "data")
        .when((size >= long_line) & (size / lines >= long_line) & (blanks / size < packed_share), "minified")
        .when((size >= 200) & names.isNotNull() & (lines >= 8) & _numbered(text, lines), "generated")
    )


def _numbered(text: Column, lines: Column) -> Column:
    """Whether nearly all lines are one line again with other numbers: a counter ran, no author."""
    shapes = F.filter(F.split(F.regexp_replace(text, r"\d+", "0"), "\n"), lambda x: F.trim(x) != "")
    counts = [text.rlike(rf"(?:^|\D){n}(?:\D|$)") for n in (1, 2, 3)]
    return (F.size(F.array_distinct(shapes)) <= 0.25 * F.size(shapes)) & counts[0] & counts[1] & counts[2]


# ---------------------------------------------------------------- attribute files


def glob_regex(glob: str) -> str | None:
    """The regex of an attribute glob over paths relative to the directory of its file; null for none.

    As in attribute files: a glob without a slash matches base names at any depth, one with a slash is
    bound to the directory; ``**`` crosses directories; a trailing slash matches nothing.
    """
    if not glob or glob.endswith("/"):
        return None
    body = glob.lstrip("/")
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**":
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (end := rest.find("]", 2)) > 0:
            inside = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", i + end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return ("" if "/" in glob else "(?:.*/)?") + out


def attribute_rules(path: str, text: str | None) -> list[tuple[str, int, int, str, str, bool]]:
    """(directory, depth, line number, glob, mark, value) of each declaration in one attribute file."""
    where = path.rpartition("/")[0]
    rules = []
    for number, line in enumerate((text or "").splitlines()):
        words = line.split()
        if len(words) < 2 or words[0].startswith("#"):
            continue
        for word in words[1:]:
            name, _, given = word.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                value = not word.startswith(("-", "!")) and given.lower() not in ("false", "0", "no")
                rules.append((where, where.count("/"), number, words[0].strip('"'), ATTRIBUTES[name], value))
    return rules


_RULES = "repo string, rules array<struct<dir:string,depth:int,line:int,glob:string,mark:string,value:boolean>>"


def declared_rules(texts: DataFrame) -> DataFrame:
    """repo, rules: what the attribute files of each repository declare."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [attribute_rules(p, t) for p, t in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"repo": b["path"].str.partition("/")[0], "rules": [[dict(zip(("dir", "depth", "line", "glob", "mark", "value"), r, strict=True)) for r in x] for x in found]})

    files = texts.where(F.col("path").rlike(r"(?:^|/)\.gitattributes$")).select("path", "content").distinct()
    parsed = files.mapInPandas(parse, _RULES)
    return parsed.groupBy("repo").agg(F.flatten(F.collect_list("rules")).alias("rules")).where(F.size("rules") > 0)


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    compiled: dict[str, re.Pattern | None] = {}
    for b in batches:
        marks = []
        for path, rules in zip(b["path"], b["rules"], strict=True):
            state: dict[str, bool] = {}
            for r in sorted(rules, key=lambda r: (r["depth"], r["line"])):
                inside = path[len(r["dir"]) + 1 :] if path.startswith(r["dir"] + "/") else None
                if r["glob"] not in compiled:
                    found = glob_regex(r["glob"])
                    compiled[r["glob"]] = re.compile(found) if found else None
                if inside is not None and (p := compiled[r["glob"]]) and p.fullmatch(inside):
                    state[r["mark"]] = r["value"]
            marks.append(next((m for m, v in state.items() if v), "own" if state else None))
        yield pd.DataFrame({"path": b["path"], "declared": marks})


def declared_marks(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, declared ('generated', 'vendored', 'own' where declared not to be, null) in repositories with rules."""
    here = paths.select("path", F.substring_index("path", "/", 1).alias("repo")).join(rules, "repo").select("path", "rules")
    return here.mapInPandas(_resolve, "path string, declared string").where("declared is not null")


def mined_names(rules: DataFrame, min_repos: int = 2) -> DataFrame:
    """kind ('dir', 'name', 'suffix'), name, mark: declarations of ``min_repos`` repositories that carry over to others."""
    each = rules.select("repo", F.explode("rules").alias("r")).where("r.value").select("repo", "r.mark", F.col("r.glob").alias("g"))
    as_dir, as_suffix = F.regexp_extract("g", r"^(?:\*\*/|/)?([\w.\-]+)/\*\*?(?:/\*)?$", 1), F.regexp_extract("g", r"^(?:\*\*/)?\*([._\-][\w.\-]+)$", 1)
    as_name = F.regexp_extract("g", r"^(?:\*\*/)?([\w.\-]+)$", 1)
    kind = F.when(as_dir != "", "dir").when(as_suffix != "", "suffix").when(as_name != "", "name")
    name = F.when(as_dir != "", as_dir).when(as_suffix != "", as_suffix).when(as_name != "", as_name)
    return each.select("repo", kind.alias("kind"), name.alias("name"), "mark").where("kind is not null").groupBy("kind", "name").agg(F.count_distinct("repo").alias("n"), F.min("mark").alias("mark")).where(F.col("n") >= min_repos).drop("n")


def mined_marks(paths: DataFrame, mined: DataFrame) -> DataFrame:
    """path, mined: the mark that mined names give a path. Each path asks with its own names, by an equi-join."""
    parts = F.split("path", "/")
    base = F.element_at(parts, -1)
    at = F.sequence(F.lit(1), F.length(base))
    suffixes = F.filter(F.transform(at, lambda i: F.substring(base, i, F.length(base))), lambda s: s.rlike(r"^[._\-]"))
    asks = F.concat(
        F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda d: F.struct(F.lit("dir").alias("kind"), d.alias("name"))),
        F.array(F.struct(F.lit("name").alias("kind"), base.alias("name"))),
        F.transform(suffixes, lambda s: F.struct(F.lit("suffix").alias("kind"), s.alias("name"))),
    )
    return paths.select("path", F.explode(asks).alias("a")).select("path", "a.kind", "a.name").join(mined, ["kind", "name"]).groupBy("path").agg(F.min("mark").alias("mined"))


def classify_files(files: DataFrame, texts: DataFrame, min_repos: int = 2) -> DataFrame:
    """path, mark, reason of the files not written by hand for their repository.

    ``files`` has path, ``texts`` path and content; repeated rows count once and null paths are dropped.
    A declaration of the repository decides, also one that a path is its own; then come mined names, well-known
    names and the text. A file without text is judged by its path.
    """
    rules = declared_rules(texts)
    paths = files.select("path").where("path is not null").distinct()
    marked = texts.select("path", text_mark(F.col("content")).alias("text_mark")).where("text_mark is not null")
    by_text = marked.groupBy("path").agg(F.min("text_mark").alias("text_mark"))
    out = (
        paths.join(by_text, "path", "left")
        .join(declared_marks(paths, rules), "path", "left")
        .join(mined_marks(paths, mined_names(rules, min_repos)), "path", "left")
        .withColumn("path_mark", path_mark(F.col("path")))
    )
    own = F.col("declared") == "own"
    mark = F.when(own, None).otherwise(F.coalesce("declared", "mined", "path_mark", "text_mark"))
    reason = F.when(F.col("declared").isNotNull(), "declared").when(F.col("mined").isNotNull(), "mined").when(F.col("path_mark").isNotNull(), "path").otherwise("text")
    return out.select("path", mark.alias("mark"), reason.alias("reason")).where("mark is not null")
