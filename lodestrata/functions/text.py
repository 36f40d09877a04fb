"""Text functions as Column expressions, with the SQL text of the few that checks share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix, replacement, least length of what stays; the first that fits holds.
STEM_RULES = (
    ("ation", "", 3), ("izing", "ize", 3), ("ating", "ate", 3), ("nning", "n", 2), ("tting", "t", 2), ("pping", "p", 2),
    ("gging", "g", 2), ("bbing", "b", 2), ("dding", "d", 2), ("mming", "m", 2), ("lling", "l", 2), ("sses", "ss", 2),
    ("ness", "", 3), ("ment", "", 3), ("tion", "", 3), ("ized", "ize", 3), ("ling", "le", 3), ("ring", "r", 3),
    ("ning", "n", 3), ("ting", "t", 3), ("ping", "p", 3), ("bing", "b", 2), ("ding", "d", 3), ("ging", "g", 3),
    ("king", "k", 3), ("ming", "m", 3), ("lled", "ll", 3), ("nned", "n", 3), ("tted", "t", 3), ("pped", "p", 3),
    ("gged", "g", 3), ("bbed", "b", 3), ("dded", "d", 3), ("ing", "", 3), ("ies", "y", 3), ("ed", "", 3), ("er", "", 3),
    ("ly", "", 3), ("es", "", 4),
)
# Abbreviations in code and what they stand for, both ways.
ABBREVIATIONS = {
    "db": "database", "auth": "authentication authorization", "config": "configuration", "ctx": "context", "env": "environment",
    "err": "error", "exec": "execute execution", "fn": "function", "func": "function", "impl": "implementation implement",
    "init": "initialize initialization", "iter": "iterator iterate", "len": "length", "lib": "library", "max": "maximum",
    "mem": "memory", "min": "minimum", "msg": "message", "num": "number", "obj": "object", "param": "parameter",
    "params": "parameters", "pkg": "package", "prev": "previous", "proc": "process procedure", "prop": "property",
    "props": "properties", "ref": "reference", "refs": "references", "repo": "repository", "req": "request",
    "res": "response result", "ret": "return", "src": "source", "str": "string", "sync": "synchronize synchronous",
    "sys": "system", "temp": "temporary", "tmp": "temporary", "val": "value", "var": "variable", "vars": "variables",
    "database": "db", "authentication": "auth", "authorization": "auth", "configuration": "config", "context": "ctx",
    "environment": "env", "error": "err", "execute": "exec", "function": "func fn", "initialize": "init",
    "initialization": "init", "iterator": "iter", "message": "msg", "parameter": "param", "parameters": "params",
    "repository": "repo", "request": "req", "response": "res", "temporary": "temp tmp", "variable": "var", "variables": "vars",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def raw_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more ASCII letters and digits; camel case is split. Null has none."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1_$2"), F.lit("[a-zA-Z0-9]{2,}"), 0), F.lower)


def stem_sql(word: str) -> str:
    """The stem of a lower-cased word as SQL text, by the first suffix rule that fits; words under five characters stay."""
    rules = "".join(f" WHEN {word} LIKE '%{s}' AND length({word}) >= {len(s) + n} THEN left({word}, length({word}) - {len(s)}) || '{to}'" for s, to, n in STEM_RULES)
    return f"CASE WHEN length({word}) < 5 THEN {word}{rules} WHEN {word} LIKE '%s' AND {word} NOT LIKE '%ss' THEN left({word}, length({word}) - 1) ELSE {word} END"


def stem(word: str) -> Column:
    """The stem of the words in a column."""
    return F.expr(stem_sql(word))


def tokens_sql(column: str) -> str:
    """Raw tokens, then stems and spelt-out abbreviations, each at most once and not where it came before as a token.

    Written as one SQL expression, as its parts are many and the same for every column; one-element
    arrays bind a value to a name, so that it is worked out once.
    """
    table = "map(" + ", ".join(f"'{w}', array({', '.join(repr(o) for o in others.split())})" for w, others in ABBREVIATIONS.items()) + ")"
    forms = f"transform(array({stem_sql('t')}), s -> array_distinct(concat(array(s), coalesce({table}[t], array()), coalesce({table}[s], array()))))[0]"
    made = f"flatten(transform(r, (t, i) -> transform({forms}, e -> struct(e, i))))"
    fresh = f"filter({made}, g -> array_position(r, g.e) = 0 or array_position(r, g.e) - 1 > g.i)"
    raw = f"transform(regexp_extract_all(regexp_replace(coalesce({column}, ''), '([a-z])([A-Z])', '$1_$2'), '[a-zA-Z0-9]{{2,}}', 0), w -> lower(w))"
    return f"transform(array({raw}), r -> concat(r, array_distinct(transform({fresh}, g -> g.e))))[0]"


def tokens(column: str) -> Column:
    """The tokens of a text column; null has none."""
    return F.expr(tokens_sql(column))


def trigrams(text: Column) -> Column:
    """Distinct lower-case trigrams; a text of under three characters is its own."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array(low)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def size_ratio(a: Column, b: Column) -> Column:
    """The smaller by the larger number; 0 where one is not positive."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def glob_regex(glob: str) -> str:
    """The regex of a shell glob over a whole string, as made when the plan is made; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def glob_match(path: Column, glob: str) -> Column:
    """Whether a path fits a glob, or ends in what fits it."""
    return path.rlike(glob_regex(glob)) | path.rlike(glob_regex("*/" + glob))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def normal_path(path: Column) -> Column:
    """The path without '.', and with '..' taken back where there is something to take."""
    parts = F.split(path, "/")
    step = lambda acc, p: (
        F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.when((p == "") | (p == "."), acc).otherwise(F.array(p))).otherwise(step(acc, p))), "/")


def kebab_to_pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(r"\b\Q" + word + r"\E\b")


def whole_word_count(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(r"\b\Q" + word + r"\E\b"))


def json_list(text: Column) -> Column:
    """A JSON list of strings; empty for null and for what is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def is_test_file(path: Column) -> Column:
    """Whether a path is one of tests, by its folders and by how its base name begins or ends."""
    return F.concat(F.lit("/"), path).rlike(r"/(?:tests?|__tests__)/") | file_stem(path).rlike(r"^test_|_test$|\.test$|\.spec$|_spec$")


def check_pattern(pattern: str, longest: int = 200) -> str:
    """A pattern that a caller may search with: not too long, without nested quantifiers, and valid."""
    if len(pattern) > longest:
        raise ValueError(f"a pattern has at most {longest} characters")
    if re.search(r"\([^()]*[+*][^()]*\)\s*[+*{]", pattern):
        raise ValueError("a pattern must not repeat what repeats")
    re.compile(pattern)
    return pattern
