"""Joins that resolve references: specifiers to files, positions to symbols, names to what they name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, file_stem, normal_path
from ..session import Cuts

# The order in which endings are tried.
SCRIPT_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
ENDINGS = (".py", *SCRIPT_ENDINGS, ".go", ".java", ".rs", ".rb", ".php", ".cs", ".sql", ".vue")


def candidates(base: Column) -> Column:
    """The paths that a specifier without or with an ending may mean, in order.

    A known ending stays, .js also means its typed forms; anything else gets every ending and the index files.
    """
    ending = F.regexp_extract(basename(base), r"(?<=.)(\.[^.]*)$", 1)
    more = F.array(*(F.concat(base, F.lit(e)) for e in ENDINGS), *(F.concat(base, F.lit("/index" + e)) for e in SCRIPT_ENDINGS), F.concat(base, F.lit("/__init__.py")))
    typed = F.array(*(F.concat(F.regexp_replace(base, r"\.js$", ""), F.lit(e)) for e in (".ts", ".tsx")))
    return F.concat(F.array(base), F.when(ending == ".js", typed).when(ending.isin(*ENDINGS), F.array().cast("array<string>")).otherwise(more))


def expand_alias(specifier: Column, aliases: Mapping[str, str]) -> Column:
    """The paths that path aliases such as '@/*' -> 'src/*' make of a specifier, in the order of the aliases."""
    out = []
    for pattern, to in aliases.items():
        if pattern.endswith("/*"):
            out.append(F.when(specifier.startswith(pattern[:-1]), F.concat(F.lit(to[:-1]), F.substring(specifier, F.lit(len(pattern)), F.length(specifier)))))
        else:
            out.append(F.when(specifier == pattern, F.lit(to)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def bases(specifier: Column, importer: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """What a specifier may stand for, in order: relative to its importer, as an absolute path, dotted, by alias."""
    near = F.when(specifier.startswith("."), F.array(normal_path(F.concat_ws("/", dirname(importer), specifier))))
    dotted = F.when(~F.contains(specifier, F.lit("/")), F.array(F.regexp_replace(specifier, r"\.", "/"))).otherwise(F.array().cast("array<string>"))
    far = F.concat(F.array(specifier), dotted, expand_alias(specifier, aliases or {}))
    return F.coalesce(near, far)


def resolve_specifiers(imports: DataFrame, files: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """importer, specifier, path: the first candidate of each import (importer, specifier) that is a file.

    Candidates become rows and meet the files by an equi-join; null where none is a file.
    """
    asked = imports.select("importer", "specifier").where("importer is not null and specifier is not null").distinct()
    every = F.flatten(F.transform(bases(F.col("specifier"), F.col("importer"), aliases), candidates))
    rows = asked.select("importer", "specifier", F.posexplode(every).alias("at", "path"))
    hit = rows.join(files.select("path").distinct(), "path").groupBy("importer", "specifier").agg(F.min_by("path", "at").alias("path"))
    return asked.join(hit, ["importer", "specifier"], "left")


def resolve_namespace(names: DataFrame, name: str, prefixes: DataFrame) -> DataFrame:
    """``names`` with path by the longest namespace prefix (prefix, dir). A name asks with each of its own prefixes."""
    parts = F.split(name, r"\\")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.concat(F.array_join(F.slice(parts, 1, i), "\\"), F.lit("\\")).alias("prefix"), i.alias("len")))
    asked = names.select(name).distinct().select(name, F.explode(ups).alias("u")).select(name, "u.*")
    best = asked.join(prefixes, "prefix").groupBy(name).agg(F.max(F.struct("len", "dir")).alias("b"))
    rest = F.array_join(F.slice(parts, F.col("b.len") + 1, F.size(parts)), "/")
    return names.join(best, name, "left").withColumn("path", F.when(F.col("b").isNotNull(), F.concat("b.dir", rest, F.lit(".php")))).drop("b")


def by_stem(names: DataFrame, name: str, files: DataFrame) -> DataFrame:
    """name, path: files whose base name without ending is the name, whatever the case."""
    stems = files.select(F.lower(file_stem(F.col("path"))).alias("__stem"), "path").distinct()
    return names.select(name).distinct().join(stems, F.lower(name) == F.col("__stem")).drop("__stem")


def barrel_closure(direct: DataFrame, reexports: DataFrame, most: int = 10) -> DataFrame:
    """importer, path, name of what imports (importer, path, name) reach through files that pass names on.

    ``reexports`` has path, target and name; a null name there passes on all. Every hop is an equi-join, and
    what was reached before is not followed again.
    """
    cuts = Cuts(direct.sparkSession)
    seen = frontier = cuts.cut(direct.select("importer", "path", "name").distinct())
    for _ in range(most):
        step = frontier.join(reexports.select("path", "target", F.col("name").alias("passed")), "path").where("passed is null or passed = name")
        frontier = cuts.cut(step.select("importer", F.col("target").alias("path"), "name").distinct().join(seen, ["importer", "path", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def resolve_points(points: DataFrame, spans: DataFrame, block: int = 256) -> DataFrame:
    """``points`` (pid, file, line, name) with symbol_id and how: 'line', 'name', 'suffix' or null.

    A point belongs to the smallest span (id, file, name, line, end_line) around its line, else to the symbol of
    its name in the file, else the same with the file whose path ends in the point's. Spans meet points by file
    and block of lines, so a large file is no nested loop; spans without an end meet by file.
    """
    size = F.col("end_line") - F.col("first")
    s = spans.select("id", "file", "name", F.col("line").alias("first"), "end_line").where("file is not null and first is not null").distinct()
    closed = s.where("end_line >= first").withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("end_line") / block))))
    p = points.select("pid", "file", "line", "name").distinct()
    inside = p.withColumn("block", F.floor(F.col("line") / block)).join(closed.drop("name"), ["file", "block"]).where("line between first and end_line")
    best = inside.select("pid", "id", size.alias("size"))
    open_ = p.join(s.where("end_line is null").select("id", "file", "first"), "file").where("line >= first").select("pid", "id", F.lit(2**40).alias("size"))
    by_line = best.unionByName(open_).groupBy("pid").agg(F.min(F.struct("size", "id")).alias("b")).select("pid", F.struct(F.lit(0).alias("o"), F.col("b.id").alias("id")).alias("b"))
    named = s.where("name is not null").groupBy("file", "name").agg(F.min("id").alias("id"))
    by_name = p.join(named, ["file", "name"]).select("pid", F.struct(F.lit(1).alias("o"), "id").alias("b"))
    # the longest path that ends in the point's path: both sides meet on the base name
    known = s.select(F.col("file").alias("path")).distinct().withColumn("base", basename(F.col("path")))
    lost = p.join(known.select(F.col("path").alias("file")), "file", "left_anti").withColumn("base", basename(F.col("file")))
    longer = lost.join(known, "base").where(F.col("path").endswith(F.concat(F.lit("/"), F.col("file"))))
    file2 = longer.groupBy("pid", "line", "name").agg(F.max(F.struct(F.length("path"), "path")).alias("m")).select("pid", "line", "name", F.col("m.path").alias("file"))
    by_suffix = file2.join(named, ["file", "name"]).select("pid", F.struct(F.lit(2).alias("o"), "id").alias("b"))
    first = by_line.unionByName(by_name).unionByName(by_suffix).groupBy("pid").agg(F.min("b").alias("b"))
    how = F.when(F.col("b.o") == 0, "line").when(F.col("b.o") == 1, "name").when(F.col("b.o") == 2, "suffix")
    return points.join(first, "pid", "left").select(*points.columns, F.col("b.id").alias("symbol_id"), how.alias("how"))


def first_tier(tiers: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """The rows of several tables of one shape with tier, each key from the first table that has it."""
    parts = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in rows.columns if c not in key and c != "tier"]
    best = rows.groupBy(*key).agg(F.min(F.struct("tier", *rest)).alias("b"))
    return best.select(*key, "b.tier", *(f"b.{c}" for c in rest))


def surest(evidence: Sequence[tuple[DataFrame, str, float]], key: str) -> DataFrame:
    """key, kind, confidence: of several kinds of evidence the surest for each key, on a tie the one named first."""
    rows = reduce(DataFrame.unionByName, (df.select(key).distinct().withColumn("o", F.lit(i)).withColumn("kind", F.lit(k)).withColumn("confidence", F.lit(c)) for i, (df, k, c) in enumerate(evidence)))
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "o", "kind")).alias("b"))
    return best.select(key, "b.kind", (-F.col("b.c")).alias("confidence"))


def column_owner(refs: DataFrame, models: DataFrame, columns: DataFrame) -> DataFrame:
    """query, alias, column, model: alias.column where that model declares it, else the query's first model that does.

    ``refs`` has query, alias (null for bare ones) and column; ``models`` query, model, at; ``columns`` model, column.
    """
    declared = columns.select("model", "column").distinct()
    own = refs.where("alias is not null").join(declared.withColumnRenamed("model", "alias"), ["alias", "column"]).select("query", "alias", "column", F.col("alias").alias("own")).distinct()
    first = refs.select("query", "column").distinct().join(models, "query").join(declared, ["model", "column"]).groupBy("query", "column").agg(F.min_by("model", "at").alias("any"))
    j = refs.distinct().join(own, ["query", "alias", "column"], "left").join(first, ["query", "column"], "left")
    return j.select("query", "alias", "column", F.coalesce("own", "any").alias("model"))


def contracts(exports: DataFrame, imports: DataFrame, least: int = 2) -> DataFrame:
    """name, owner, importers: names that one member of a group exports and ``least`` others import.

    Both have member and name; names that several members export are nobody's.
    """
    owned = exports.groupBy("name").agg(F.min("member").alias("owner"), F.count_distinct("member").alias("n")).where("n = 1").drop("n")
    used = imports.select("name", "member").distinct()
    return used.join(owned, "name").where("member <> owner").groupBy("name", "owner").agg(F.count("*").alias("importers")).where(F.col("importers") >= least)


def name_taken(symbols: DataFrame, targets: DataFrame, near: DataFrame) -> DataFrame:
    """id, new_name, collision of renames (id, file, new_name): whether the file or one that uses it has the name already.

    ``near`` has file and new_name: the files that are used from a file which has the name.
    """
    own = symbols.select("file", F.col("name").alias("new_name"))
    taken = own.unionByName(near.select("file", "new_name")).distinct()
    hit = targets.join(taken, ["file", "new_name"], "left_semi").select("id", "new_name").distinct().withColumn("collision", F.lit(True))
    return targets.select("id", "new_name").distinct().join(hit, ["id", "new_name"], "left").withColumn("collision", F.coalesce("collision", F.lit(False)))


def ladder(df: DataFrame, key: str, steps: Sequence[tuple[DataFrame, str]], rest: str) -> DataFrame:
    """key, verdict: the first step whose table has the key, else ``rest``."""
    out = df.select(key).distinct()
    for i, (has, _) in enumerate(steps):
        out = out.join(has.select(key).distinct().withColumn(f"h{i}", F.lit(True)), key, "left")
    verdict = reduce(lambda acc, s: acc.when(F.col(f"h{s[0]}"), s[1][1]), enumerate(steps[1:], 1), F.when(F.col("h0"), steps[0][1]))
    return out.select(key, verdict.otherwise(rest).alias("verdict"))


def base_names(signature: Column) -> Column:
    """The names that a class signature says it extends or implements, or has in brackets if it says neither."""
    after = lambda word: F.regexp_extract(signature, rf"\b{word}\s+([\w.,\s<>]+?)(?=\s+(?:extends|implements)\b|\{{|:|$)", 1)
    split = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, "<[^<>]*>", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    said = F.concat(split(after("extends")), split(after("implements")))
    bracket = F.filter(split(F.regexp_extract(signature, r"\bclass\s+\w+\s*\(([^()]*)\)", 1)), lambda x: x.rlike(r"^[A-Z][\w.]*$"))
    return F.when(F.size(said) > 0, said).otherwise(bracket)


def root_package(specifier: Column, language: Column) -> Column:
    """The package that a specifier belongs to; null for relative ones."""
    script = F.when(specifier.startswith("@"), F.regexp_extract(specifier, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.substring_index(specifier, "/", 1))
    dotted = F.substring_index(specifier, ".", 1)
    low = F.lower(language)
    return F.when(specifier.startswith("."), None).when(low.isin("javascript", "typescript", "js", "ts"), script).when(low == "go", F.array_join(F.slice(F.split(specifier, "/"), 1, 3), "/")).when(low == "java", F.array_join(F.slice(F.split(specifier, r"\."), 1, 2), ".")).otherwise(dotted)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by an order, with ties by the whole row."""
    cols = [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), *cols)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
