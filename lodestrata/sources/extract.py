"""Extraction from source texts: symbols, imports and syntax nodes, one file in and many rows out."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "path string, kind string, name string, text string, line int, end_line int, depth int"
# How declarations look in languages without a parser here: language, kind, pattern with the name.
DECLARATIONS = (
    ("javascript", "class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("typescript", "type", r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)"),
    ("go", "function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("go", "type", r"^type\s+(\w+)"),
    ("java", "class", r"^\s*(?:public|private|protected|abstract|final|static|\s)*(?:class|interface|enum|record)\s+(\w+)"),
    ("java", "method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\("),
)
# How a language names what it imports.
IMPORTS = {
    "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*)['"]([^'"\n]+)['"]""",
    "typescript": r"""(?:\bfrom\s+|\bimport\s+|\brequire\(\s*)['"]([^'"\n]+)['"]""",
    "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"([^"\n]+)"\s*$',
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;",
    "rust": r"(?m)^\s*use\s+([\w:]+)",
    "c": r'(?m)^\s*#\s*include\s*[<"]([^>"\n]+)[>"]',
    "ruby": r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"\n]+)['"]""",
    "php": r"(?m)^\s*use\s+([\w\\]+)",
    "scala": r"(?m)^\s*import\s+([\w.]+)",
    "swift": r"(?m)^\s*import\s+(\w+)",
    "haskell": r"(?m)^import\s+(?:qualified\s+)?([\w.]+)",
    "dart": r"""(?m)^\s*import\s+['"]([^'"\n]+)['"]""",
}


def imported(text: Column, language: str) -> Column:
    """The distinct specifiers that a text imports, in order; a language without a pattern has none."""
    if language not in IMPORTS:
        return F.array().cast("array<string>")
    pattern = IMPORTS[language]
    groups = re.compile(pattern.replace("(?m)", "")).groups
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    part = lambda h: F.array_join(F.filter(F.array(*(F.regexp_extract(h, pattern, i + 1) for i in range(groups))), lambda x: x != ""), "")
    return F.array_distinct(F.transform(hits, part))


def _python_nodes(path: str, text: str) -> list[tuple]:
    """Nodes of a text, of its longest beginning of whole top-level blocks where it is cut off."""
    lines = text.split("\n")
    tree = None
    for end in [len(lines), *(i for i in range(len(lines) - 1, 0, -1) if lines[i][:1] not in ("", " ", "\t", ")", "]", "}"))]:
        try:
            tree = ast.parse("\n".join(lines[:end]))
            break
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    if tree is None:
        return []
    out, stack = [], [(tree, 0, False)]
    loops = (ast.For, ast.While, ast.AsyncFor)
    while stack:
        node, depth, inside = stack.pop()
        kind = name = None
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, name = ("method" if inside else "function"), node.name
        elif isinstance(node, ast.ClassDef):
            kind, name = "class", node.name
        elif isinstance(node, ast.Call):
            kind, name = "call", ast.unparse(node.func)[:200]
        elif isinstance(node, loops):
            kind, name = "loop", type(node).__name__
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            kind, name = "string", node.value[:200]
        if kind:
            out.append((path, kind, name, lines[node.lineno - 1].strip()[:200], node.lineno, node.end_lineno, depth))
        block = isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.If, ast.With, ast.Try, *loops))
        stack += [(child, depth + block, isinstance(node, ast.ClassDef)) for child in ast.iter_child_nodes(node)]
    return out


def python_nodes(texts: DataFrame) -> DataFrame:
    """Functions, methods, classes, calls, loops and strings of Python texts (path, content), with line and depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, t in zip(b["path"], b["content"], strict=True) for r in _python_nodes(p, t)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "text", "line", "end_line", "depth"]).astype({"line": "int32", "end_line": "int32", "depth": "int32"})

    return texts.select("path", "content").where("content is not null").mapInPandas(run, NODES)


def declared(texts: DataFrame, language: str) -> DataFrame:
    """path, kind, name, line of the declarations of another language, found line by line."""
    lines = texts.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    out = None
    for lang, kind, pattern in DECLARATIONS:
        if lang == language or (lang == "javascript" and language == "typescript"):
            part = lines.where(F.col("text").rlike(pattern)).select("path", F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, 1).alias("name"), (F.col("at") + 1).alias("line"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else lines.select("path", F.lit("").alias("kind"), F.col("text").alias("name"), F.col("at").alias("line")).limit(0)


def overload_ids(symbols: DataFrame, line: str = "line") -> DataFrame:
    """``symbols`` (path, qualified_name, kind) with id; those of one name and kind get ~1, ~2, ... from the second on."""
    base = F.concat("path", F.lit("::"), "qualified_name", F.lit("#"), "kind")
    n = F.row_number().over(Window.partitionBy("path", "qualified_name", "kind").orderBy(line)) - 1
    return symbols.withColumn("id", F.when(n == 0, base).otherwise(F.concat(base, F.lit("~"), n.cast("string"))))


_DSL = re.compile(r"^(call|string|comment|nesting|loops|lines)\s*:\s*(.+)$")


def node_filter(pattern: str) -> Column:
    """The condition over nodes of a search such as 'call:eval', 'string:/^sk-/', 'nesting:>3', 'lines:>40' or 'loops:>=2'."""
    found = _DSL.match(pattern.strip())
    if not found:
        raise ValueError(f"no search: {pattern}")
    what, value = found[1], found[2].strip()
    if what in ("call", "string", "comment"):
        test = F.col("name").rlike(value[1:-1]) if value.startswith("/") and value.endswith("/") else F.col("name").contains(value) if what != "call" else F.col("name") == value
        return (F.col("kind") == what) & test
    number = re.match(r"^(>=|<=|>|<|=)?\s*(\d+)$", value)
    if not number:
        raise ValueError(f"no number: {pattern}")
    x = {"nesting": F.col("depth"), "loops": F.when(F.col("kind") == "loop", F.col("depth")), "lines": F.when(F.col("kind").isin("function", "method"), F.col("end_line") - F.col("line") + 1)}[what]
    n = int(number[2])
    return {">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n, "=": x == n}[number[1] or ">="]


def enclosing(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``nodes`` with symbol: the enclosing symbol that begins last; a missing end is 999 lines on."""
    s = symbols.select(F.col("file").alias("path"), "id", F.col("line").alias("first"), F.coalesce("end_line", F.col("line") + 999).alias("last")).distinct()
    keyed = nodes.withColumn("nid", F.xxhash64(*nodes.columns))
    hit = keyed.select("nid", "path", "line").join(s, "path").where("line between first and last")
    best = hit.groupBy("nid").agg(F.max(F.struct("first", "id")).alias("b")).select("nid", F.col("b.id").alias("symbol"))
    return keyed.join(best, "nid", "left").drop("nid")


def call_owners(nodes: DataFrame) -> DataFrame:
    """path, caller, callee: each call by the innermost function around it, calls of itself left out."""
    calls = nodes.where("kind = 'call'").select("path", "line", F.element_at(F.split("name", r"\."), -1).alias("callee"))
    fns = nodes.where("kind in ('function', 'method')").select("path", F.col("name").alias("caller"), F.col("line").alias("first"), F.col("end_line").alias("last"))
    inside = calls.join(fns, "path").where("line between first and last")
    best = inside.groupBy("path", "line", "callee").agg(F.max_by("caller", "first").alias("caller"))
    return best.where("caller <> callee").select("path", "caller", "callee").distinct()


def hashed_vector(text: Column, size: int = 64) -> Column:
    """A vector of length one from the trigrams of a text: an embedding that needs no model."""
    from ..functions.text import let, trigrams

    slots = F.transform(trigrams(text), lambda g: F.pmod(F.xxhash64(g), F.lit(size)))
    counts = let(slots, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda s: s == i)).cast("double")))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    # each is bound once, as an expression inside a lambda is worked out again for every element
    return let(counts, lambda c: let(length(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))
