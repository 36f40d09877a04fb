"""Operators on texts: files, documentation, encoding, look-alikes."""

import random
import re

import pytest

from lodestrata.llm import codefiles as C
from lodestrata.llm import docpairs as D
from lodestrata.llm import encode as E
from lodestrata.llm import lookalike as L


# ---------------------------------------------------------------- files


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("*.pb.go", "a/b/x.pb.go", True), ("/x.go", "a/x.go", False), ("gen/*.go", "gen/a.go", True), ("gen/*.go", "gen/a/b.go", False), ("gen/**", "gen/a/b.go", True), ("**/gen/**", "a/gen/b/c.py", True), ("a?[!b].c", "axc.c", True), ("dir/", "dir/a", False)],
)
def test_attribute_globs(glob, path, fits):
    found = C.glob_regex(glob)
    assert bool(found and re.fullmatch(found, path)) == fits


def marks(spark, files, texts):
    f = spark.createDataFrame([(p, None, "x") for p in files], "path string, size_bytes bigint, content string")
    t = spark.createDataFrame(texts, "path string, content string")
    return {r["path"]: (r["mark"], r["reason"]) for r in C.classify_files(f, t).collect()}


def test_declarations_rule_by_depth_and_line(spark):
    files = ["r1/lib/a.js", "r1/lib/own.js", "r1/src/vendor/a.go", "r1/lib/sub/b.js", "r2/out/a.py", "r3/out/b.py", "r4/out/c.py", "r4/x/d_tpl.py", None, "r1/lib/a.js"]
    texts = [
        ("r1/.gitattributes", "lib/** linguist-generated\nlib/own.js -linguist-generated\nsrc/vendor/** linguist-vendored=false\n# no\n"),
        ("r1/lib/sub/.gitattributes", "*.js linguist-generated=false"),
        ("r2/.gitattributes", "out/** linguist-generated\n*_tpl.py linguist-vendored"),
        ("r3/.gitattributes", "out/** linguist-generated=true\n*_tpl.py linguist-vendored"),
    ]
    got = marks(spark, files, texts)
    assert got == {"r1/lib/a.js": ("generated", "declared"), "r2/out/a.py": ("generated", "declared"), "r3/out/b.py": ("generated", "declared"), "r4/out/c.py": ("generated", "mined"), "r4/x/d_tpl.py": ("vendored", "mined")}


def test_names_and_texts(spark):
    texts = [
        ("r/a/min.js", "function f(a,b){return a?b.c(7):d}" * 90),
        ("r/a/hand.js", "// Do not edit the limits without asking the owners.\nfunction f() {\n  return 1;\n}\n" * 20),
        ("r/a/made.py", "# This file was automatically generated from x.schema; do not change it by hand.\nA = 1\n"),
        ("r/a/copy.py", "# Copied from lib 1.2.3, keep in sync with upstream\ndef f():\n    return 1\n"),
        ("r/a/data.py", "D = [" + "0x1f, 0x2a, " * 200),
        ("r/a/table.py", "class Lease:\n    pass\nTABLE = [" + "0x1f, 0x2a, " * 40 + "0]\n"),
        ("r/a/rows.js", "const rows = [\n" + '  {"id": 1742, "w": 0.2519},\n' * 400 + "];\nfunction row(i) {\n  return rows[i];\n}\n"),
        ("r/a/null.py", None),
        ("r/a/empty.py", ""),
        ("r/a/long.py", "def f(x):\n    return x + y\n" * 60_000),
        ("r/a/long.js", "x" * 3_000_000),
        ("r/a/fields.py", "\n".join(f"F_{i} = ({i}, 'name_{i}')" for i in range(1, 60))),
        ("r/a/stubs.py", "\n".join(f"class ThingStub{i}:\n    def call(self, request):\n        raise NotImplementedError()\n" for i in range(1, 30))),
    ]
    files = [p for p, _ in texts] + ["r/vendor/z.go", "vendor/src/z.go", "r/src/vendors/z.go", "r/src/app.min.js", "r/src/min.go", "r/only_path.py"]
    got = {p: m for p, (m, _) in marks(spark, files, texts).items()}
    assert got == {"r/a/min.js": "minified", "r/a/made.py": "generated", "r/a/copy.py": "vendored", "r/a/data.py": "data", "r/a/rows.js": "data", "r/a/long.js": "data", "r/a/fields.py": "data", "r/a/stubs.py": "generated", "r/vendor/z.go": "vendored", "r/src/app.min.js": "generated"}


def test_no_files(spark):
    assert marks(spark, [], []) == {}


# ---------------------------------------------------------------- documentation

TRIVIAL = [
    None, "", "  ", "/** */", "----", "TODO: document", "todo write docs", "FIXME document this before the release", "TODO Auto-generated method stub", "Parses the config.", "parse_config", "This function parses the config.",
    "@param x\n@return", ":param x:\n:return:", "Args:\n    x:\n\nReturns:\n", "[summary]\n\nArgs:\n    x ([type]): [description]", "see above", "@see Base", "{@inheritDoc}", "(non-Javadoc)", "N/A", "noqa: D103", "@ts-ignore",
    "if (x == null) { return; }", "print(x)", "x = load(y)\nreturn x", "const a = await f(b, { c: true });\nlog.debug(a);", "<p></p>", "Enter a summary of this function.", "Same as parent.", "Description", "...", "/// ---",
]
TELLING = [
    "Blocks until the queue drains.", "Todo items are sorted by priority before the graph sees them.", "TODO: cover in tests\nRaises when the token belongs to another session.", "None is a valid value here and means that nothing was read yet.",
    "/**\n * Rounds half up, as the ledger did before version 2.\n * @param x\n */", "Liest den Index zeilenweise und überspringt ungültige Einträge.", "構成を読み込み、結果を返します。", "parse_config falls back to defaults when the file is missing.", "Placeholders such as ${x} are filled in from the header first.",
]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial_comments(doc):
    assert not D.describes(doc, "parse_config")


@pytest.mark.parametrize("doc", TELLING)
def test_telling_comments(doc):
    assert D.describes(doc, "parse_config")


def test_units_from_source():
    js = '/** Joins both parts with a colon, "}" or not. */\nfunction join(a, b = "){") {\n  const s = "}"; // }\n  return [a, b].join(":");\n}\n// TODO\nfunction other() { return 1; }\n'
    found = D.pair_units(js, "javascript")
    assert [s for s, _, _ in found] == ['function join(a, b = "){")'] and found[0][2].endswith('join(":");\n}')
    py = 'class A:\n    def f(self, x=(1, "):")):\n        """Walks upwards until a root turns up."""\n        return x\n\n    def g(self):\n        """g"""\n        return 2\n'
    (unit,) = D.pair_units(py, "python")
    assert unit[0].startswith("def f(self") and "return x" in unit[2] and "def g" not in unit[2]
    assert D.pair_units(None, None) == [] and D.pair_units("", "python") == []
    assert isinstance(D.pair_units("/** a */ function f(" + "(" * 3000, "js"), list)


def test_symbol_pairs(spark):
    schema = "id string, kind string, name string, signature string, docstring string, symbol_id int"
    rows = [
        ("a", "Function", "f", "def f(x)", TELLING[0], 1), ("a", "Function", "f", "def f(x)", TELLING[0], 1), ("b", "METHOD", "g", "g() {", TELLING[2], 1), ("c", "class", "C", "class C", TELLING[0], 1), ("d", "method", None, None, TELLING[1], 1),
        (None, "function", "h", "h()", TELLING[0], 1), ("e", "function", "parse_config", "def parse_config()", "Parse config.", 1), ("f", None, "k", "k()", TELLING[0], 1), ("g", "method", "m", "m(", "*/ " + TELLING[0], 1), ("h", "method", "m", "m()", "x = 1\n" * 50_000, 1),
    ]
    got = {r["symbol_id"] for r in D.pair_symbols(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a", "b", "d", "g"}
    assert D.pair_symbols(spark.createDataFrame([], schema)).count() == 0


# ---------------------------------------------------------------- encoding


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoding_is_exact(reference):
    e = E.encoder(E.VOCABULARY)
    rng = random.Random(5)
    alphabet = list("ab '\n\t\r\u3000\xa0\u00e9日本1２!?.,\x1c\x85\u200d\u2019sll<|endoftext|>") + ["👩", "don't", "  ", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert e.encode(text) == reference(text)
    for text in ("日本語のテキスト" * 300, "x" * 5000, "a b " * 3000, "<|endoftext|>"):
        assert e.encode(text) == reference(text)
        assert sum((e.encode(b) for b in e.blocks(text, 100)), []) == reference(text)


def test_forced_boundaries_are_those_of_the_vocabulary(reference):
    e = E.encoder(E.VOCABULARY)
    blank = [e.certain_cut(ord(c), ord(" ")) for c in "abcxyzABZ019.,;"]
    assert all(blank) and not e.certain_cut(ord("t"), ord("h"))
    rng = random.Random(9)
    cut = 0
    for _ in range(300):
        piece = "".join(rng.choice("abqxzéß日本") for _ in range(rng.randint(1, 30)))
        parts = e.forced(piece.encode())
        cut += len(parts) - 1
        assert b"".join(parts) == piece.encode()
        assert all(e.certain_cut(a[-1], b[0]) for a, b in zip(parts, parts[1:]))
        assert not any(e.certain_cut(a, b) for p in parts for a, b in zip(p, p[1:]))
        assert sum((e.core._encode_single_piece(p) for p in parts), []) == e.core._encode_single_piece(piece.encode())
    assert cut > 50


def test_corpus_encoding(spark, reference):
    texts = {1: "Hello  world\n", 2: None, 3: "", 4: "lorem ipsum dolor " * 500, 5: "ohne Pause" * 400, 6: " \n\n ", 7: "日本語 " * 300}
    df = spark.createDataFrame([(k, v, "ids") for k, v in texts.items()], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in E.encode_corpus(df, long_chars=1000).collect()}
    assert got == {k: reference(v) if v else [] for k, v in texts.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in E.token_counts(df, long_chars=1000, keep=["ids"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert E.encode_corpus(df.limit(0)).count() == 0


# ---------------------------------------------------------------- look-alikes


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id bigint, text string, canonical string")
    return {(r[0], r[1]) for r in L.same_looking_pairs(L.canonical_texts(df)).collect()}


def test_same_looking_texts(spark):
    base = "Der Schlüssel wird geprüft, copy no 7\n"
    same = [base.replace("o", "\u043e"), base.replace("ü", "u\u0308"), base.replace(" ", "\u00a0"), base.replace("copy", "ｃｏｐｙ"), "\u200b" + base, base.replace("copy", "\u0441\u043e\u0440\u0443")]
    other = [base.upper(), base.replace("ü", "u"), base.replace("7", "1"), base.replace("\n", "\r\n"), base + " "]
    texts = list(enumerate([base, *same, base, *other, None, "", " ", "\u00a0"]))
    group = [i for i, t in texts if t == base or t in same]
    want = {(a, b) for a in group for b in group if a < b and texts[a][1] != texts[b][1]}
    assert pairs(spark, texts) == want


def test_whole_words_of_another_script(spark):
    assert pairs(spark, [(1, "сор а"), (2, "cop a"), (3, "сор а"), (4, "сор б")]) == {(1, 2), (2, 3)}
    assert pairs(spark, []) == set()


def test_trie_is_as_good_as_the_table():
    words = [("copy", 9), ("\u0441\u043e\u0440\u0443", 3), ("scope", 4), ("n\u00f3", 1)]
    s = L.Speller(words)
    rng = random.Random(2)
    for _ in range(500):
        word = rng.choice(["copy", "scope", "nope", "xyz", "\u0441\u043e\u0440\u0443"])
        a, b = ("".join(rng.choice(L._ALIKE.get(c, c)) for c in word) for _ in range(2))
        assert s.token(a) == s.token(b)
    assert s.token("\u0441\u043e\u0440\u0443") == "copy"
    assert L.Trie(words).spell("c\u200bopx", bound=1) == "copy" and L.Trie(words).spell("copx") is None


def test_long_text_keeps_its_end(spark):
    long = "word " * 200_000
    assert pairs(spark, [(1, long + "а"), (2, long + "a"), (3, long + "b")]) == {(1, 2)}
