"""Functions paired with the documentation that describes them.

A unit is a comment, a signature and a balanced body. One recursive pattern of the ``regex`` library
captures the three together; strings and comments are taken as wholes, so brackets in them do not count.
``pair_units`` runs it over source texts. ``pair_symbols`` runs it over rows that hold signature and
docstring already: each is put as one unit first, so both go the same way. What a trivial comment leaves
after markup, directives, placeholders, pointers, code and the words of the name are gone is nothing.

Both run batch by batch in Python on the rows that have a comment at all; nothing is shuffled but to
count repeated rows once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = r"""
(?(DEFINE)
 (?<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
 (?<com>/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*+)
 (?<tok>(?&str)|(?&com)|[^()\[\]{}"'`/]++|/)
 (?<par>\((?:(?&tok)|(?&par)|(?&sqr)|(?&cur))*+\))
 (?<sqr>\[(?:(?&tok)|(?&par)|(?&sqr)|(?&cur))*+\])
 (?<cur>\{(?:(?&tok)|(?&par)|(?&sqr)|(?&cur))*+\})
)"""
#: comment, signature with balanced parameters, balanced body, for languages with braces
BRACED = re.compile(
    _PARTS
    + r"""
(?<comment>/\*\*?(?:[^*]|\*(?!/))*+\*/|(?:^[^\S\n]*//[^\n]*\n)+)\s*+
(?<signature>(?:[\w.$<>,@*&:?~\s]|(?&sqr)|(?&str)){1,400}?(?<params>(?&par))(?:[^\S\n]|[\w.$<>,*&:?|\[\]()])*+)\s*+
(?<body>(?&cur)|;)""",
    re.X | re.M,
)
#: the same for a language with indented bodies and the comment inside
INDENTED = re.compile(
    _PARTS
    + r"""
^(?<indent>[^\S\n]*)(?<signature>(?:async[^\S\n]+)?def[^\S\n]+\w+[^\S\n]*(?<params>(?&par))[^:\n]*):[^\S\n]*(?:\#[^\n]*)?\n
(?:\s*\n)?(?<body>(?P=indent)[^\S\n]+[rRuU]?(?<quote>\"{3}|'{3})(?<comment>[\s\S]*?)(?P=quote)(?:\n(?:(?P=indent)[^\S\n]+[^\n]*|[^\S\n]*(?=\n)))*)""",
    re.X | re.M,
)
#: one row put as a unit; a signature with unbalanced brackets is taken as it is
ROW = re.compile(
    _PARTS
    + r"""\A(?<comment>/\*\*(?:[^*]|\*(?!/))*+\*/)\n(?<signature>(?:(?:(?&tok)|(?&sqr)|(?&cur))*?(?<params>(?&par))(?:(?&tok)|(?&par)|(?&sqr)|(?&cur))*+)|[\s\S]*?)\s(?<body>\{\})\Z""",
    re.X,
)

_MARKER = re.compile(r"^[^\S\n]*(?:/\*+!?|\*+/|//+!?|\#+!?|\*+|--+|;;+|%+|\"{3}|'{3})[^\S\n]?", re.M)
_ENDING = re.compile(r"[^\S\n]*(?:\*+/|\"{3}|'{3}|-->)[^\S\n]*$", re.M)
_INLINE = re.compile(r"\{@(?:inheritdoc|docroot)\}", re.I)
_LINK = re.compile(r"\{@\w+\s+([^{}]*)\}")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|<!--|-->")
_WORD = re.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\p{L}+")
_IDEO = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=\S)")

# Notes to tools, not to readers.
_DIRECTIVE = re.compile(
    r"^@?(?:ts-(?:ignore|nocheck|expect-error|check)|eslint\b|eslint-|noqa\b|type:\s*ignore|pylint:|nolint\b|pragma:?|noinspection|prettier-ignore|istanbul|"
    r"coverage:|fmt:|mypy:|flake8|rubocop|nosonar|clang-format|suppresswarnings|isort|js[hl]int|tslint|go:\w|lint:|[cv]8 ignore|stylelint|phpcs|yapf:|pyright:|sourcery|spell-?checker|cspell)",
    re.I,
)
# Tags whose rest says nothing about the symbol itself.
_SILENT = re.compile(r"^[@\\](?:see|author|since|version|inheritdoc|override|hide|internal|private|public|ignore|api|todo|date|copyright|license|module|package|file|category|link)\b.*$|^[@\\]deprecated\W*$", re.I)
_PARAM = re.compile(r"^(?:[@\\:](?:param|parameter|arg|argument|tparam|type|property|throws|exception|raises?|return|returns|rtype|yields?)\b:?[^\S\n]*)(?:\{[^{}]*\}\s*)?(.*)$", re.I)
_NAMED = re.compile(r"^[@\\:](?:param|parameter|arg|argument|tparam|type|property|throws|exception|raises?)\b", re.I)
_SECTION = re.compile(r"^(?:args|arguments|parameters?|params|returns?|raises|yields|throws|attributes|examples?|notes?|see also|inputs?|outputs?)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^[\w$*.]+\s*(?:\([^()]*\))?\s*:\s*(.*)$")
_TODO = re.compile(r"^(?:todo|fixme|fix me|xxx+|hack|wip|tbd|tbc)\b(?P<rest>.*)$", re.I)
# What stands in for a description that nobody wrote.
_EMPTY = re.compile(
    r"""^\W*(?:
 |(?:the\s+)?(?:description|docstring|documentation|summary|comments?|none|null|nil|n\s*/?\s*a|tbd|tbc|wip|todo|fixme|xxx+|placeholder|stub|dummy|undocumented|unknown|deprecated|internal|private|inherited|self-explanatory|no\s*op|not\s+documented|lorem\s+ipsum\b.*)(?:\s+goes)?(?:\s+here)?
 |(?:please\s+)?(?:write|enter|add|insert|put|fill\s+in|provide|type|describe|document|update|give|complete|replace)\b.{0,50}\b(?:here|descriptions?|summary|documentation|docs?|comments?|docstring|(?:this|the)\s+(?:function|method|class))
 |(?:no|missing|empty|needs?|without|lacks?|requires?|awaiting)\s+(?:a\s+|the\s+)?(?:description|documentation|docs?|comments?|docstring)(?:\s+\w+){0,3}
 |(?:todo\W*)?(?:this\s+is\s+an?\s+)?(?:auto-?|automatically\s+)?generated\s+(?:(?:method|function|class|constructor|catch|code|getter|setter)\s+)?(?:stub|block|body|code|comment|documentation|docs?)
 |comment\s+required\s+by\b.*
 |to\s+be\s+(?:documented|written|filled|added|done|replaced|completed)\b.*
 |created\s+by\s+the\b.*\bwizard\b.*
 |feel\s+free\s+to\s+(?:edit|change)\b.*
 |.{0,20}\bhere
 |non-javadoc
 |(?:\w+\s+)?docs
)\W*$""",
    re.I | re.X,
)
_POINTER = re.compile(r"^\W*(?:see|cf|refer\s+to|same\s+as|inherited|inherits|like|as\s+in|as\s+above|delegates\s+to|overrides?|override\s+of|alias\s+(?:of|for)|ditto|idem)\b", re.I)
_BRACKETED = re.compile(r"^\W*(?:\[[^\[\]]*\]|<[^<>]*>|\{\{[^{}]*\}\}|\$\{[^{}]*\}|_{2,}\w+_{2,})\W*$")
#: A line of code. The balanced parts keep brackets inside strings from counting.
_CODE = re.compile(
    _PARTS
    + r"""^\s*(?:
 (?=.*[(=]).*[;{}]\s*
 |(?:(?:const|let|var|final|auto|val)\s+)?[\w.\[\]$]+\s*(?:\#?:?=|[-+*/|&]=)\s*\S.*
 |return(?:\s+(?:[\w.$]+(?:(?&par)|(?&sqr))*|(?&str)|-?\d+|(?&par)|(?&sqr)|(?&cur)))?\s*;?\s*
 |(?:await\s+|yield\s+|new\s+|throw\s+|raise\s+|del\s+|!)*[\w$]+(?:(?:\.|::|->)[\w$]+)*\s*(?:(?&par)(?:\.[\w$]+(?&par)?)*)\s*;?\s*
 |(?:for|while)\b.*\bin\b.*:\s*
 |(?:if|elif|while|with|for|def|class|try|except|switch|catch)\b.*[:{]\s*
 |(?:if|for|while|switch|catch)\s*(?&par).*[;{})]\s*
 |else\s*:?\s*|pass|break;?|continue;?|end;?|\}.*
 |(?:import|from|package|using|\#include)\s+[\w.*"<>/]+(?:\s+import\s+[\w.*,\s]+)?\s*;?
)$""",
    re.X,
)
# Words that carry nothing in a comment.
_STOP = frozenset(
    "a an the this that these those it its is are was were be been to of for in on at by with and or from into as used use uses using function functions method "
    "methods class procedure routine helper which when will can does do doing done simply just given some any returns return implements implementation performs perform "
    "responsible handles constructor called void we you i if our your all new no not".split()
)


def _stem(word: str) -> str:
    w = word.lower()
    for end, to in (("ies", "y"), ("ied", "y"), ("ing", ""), ("es", ""), ("ed", ""), ("s", ""), ("e", "")):
        if w.endswith(end) and len(w) - len(end) >= 2:
            w = w[: -len(end)] + to
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou" else w


def _lines(doc: str) -> list[str]:
    text = doc
    for _ in range(3):  # markers may be nested, as in a comment pasted into a comment
        text = _MARKER.sub("", _ENDING.sub("", text))
    text = _TAG.sub(" ", _LINK.sub(r"\1", _INLINE.sub(" ", text)))
    return [line.strip() for line in text.splitlines()]


def prose(doc: str) -> list[str]:
    """The sentences of a comment that are neither markup, directive, placeholder, pointer nor code."""
    out, in_list = [], False
    for line in _lines(doc):
        if not line or not any(c.isalpha() for c in line) or _DIRECTIVE.match(line) or _SILENT.match(line):
            continue
        if _SECTION.match(line):
            in_list = True
            continue
        if found := _PARAM.match(line):
            rest = found[1].strip()
            if _NAMED.match(line):  # the first word is the parameter
                rest = rest.split(None, 1)[1] if len(rest.split(None, 1)) > 1 else ""
                rest = rest.lstrip(":- ")
            line = rest
        elif in_list and (found := _ITEM.match(line)):
            line = found[1].strip()
        elif (found := _ITEM.match(line)) and not found[1].strip():
            continue
        if todo := _TODO.match(line):
            first = line.split()[0]
            if first.isupper() or todo["rest"][:1] in ":(-!," or len(line.split()) <= 5:
                continue
        if not line or _CODE.match(line):
            continue
        for sentence in _SENTENCE.split(line):
            if _EMPTY.match(sentence) or _BRACKETED.match(sentence):
                continue
            if _POINTER.match(sentence) and len(sentence.split()) <= 4:
                continue
            out.append(sentence)
    return out


def describes(doc: str | None, name: str | None, least_words: int = 2) -> bool:
    """Whether a comment says something about its symbol: ``least_words`` words that are not its name again."""
    if not doc:
        return False
    known = {_stem(w) for w in _WORD.findall(name or "")}
    left: set[str] = set()
    for sentence in prose(doc):
        if len(_IDEO.findall(sentence)) >= 4:
            return True
        for word in _WORD.findall(sentence):
            low = word.lower()
            if len(low) > 1 and low not in _STOP and (stem := _stem(low)) not in known:
                left.add(stem)
        if len(left) >= least_words:
            return True
    return False


def pair_units(text: str | None, language: str | None) -> list[tuple[str, str, str]]:
    """(signature, comment, body) of each documented unit in one source text, trivial comments left out."""
    out = []
    for m in (INDENTED if (language or "").lower() in ("python", "py") else BRACED).finditer(text or ""):
        signature = " ".join(m["signature"].split())
        head = signature.partition("(")[0].split()
        if head and head[0] not in ("if", "for", "while", "switch", "return", "catch", "else") and describes(m["comment"], head[-1]):
            out.append((signature, m["comment"], m["body"]))
    return out


def pair_source(texts: DataFrame) -> DataFrame:
    """path, signature, docstring, body of the documented functions in source texts (path, content, language).

    Null and empty texts have none; repeated rows count once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *u) for p, t, lang in zip(b["path"], b["content"], b["language"], strict=True) for u in pair_units(t, lang)]
            yield pd.DataFrame(rows, columns=["path", "signature", "docstring", "body"])

    return texts.select("path", "content", "language").where("content <> ''").mapInPandas(run, "path string, signature string, docstring string, body string").distinct()


def _paired(docs: pd.Series, signatures: pd.Series, names: pd.Series) -> list[bool]:
    out = []
    for doc, signature, name in zip(docs, signatures, names, strict=True):
        m = ROW.match("/**" + doc.replace("*/", "* /") + "*/\n" + (signature or "") + " {}")
        comment = m["comment"][3:-2] if m else doc
        out.append(describes(comment.replace("* /", "*/"), name or (signature or "").partition("(")[0]))
    return out


def is_function(kind: Column) -> Column:
    return F.lower(F.trim(kind)).isin("function", "method")


def pair_symbols(symbols: DataFrame) -> DataFrame:
    """symbol_id, signature, docstring of the functions and methods whose docstring describes them.

    Rows are symbols with id, kind, name, signature and docstring. Null ids, null and blank docstrings make
    no pair; a null signature or name stays as it is. An id with several rows comes out once, with the smallest pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[_paired(b["docstring"], b["signature"], b["name"])][["symbol_id", "signature", "docstring"]]

    rows = symbols.where(is_function(F.col("kind")) & F.col("id").isNotNull() & F.col("docstring").rlike(r"\p{L}"))
    pairs = rows.select(F.col("id").alias("symbol_id"), "name", "signature", "docstring").mapInPandas(run, "symbol_id string, signature string, docstring string")
    return pairs.groupBy("symbol_id").agg(F.min(F.struct("docstring", "signature")).alias("p")).select("symbol_id", "p.signature", "p.docstring")
