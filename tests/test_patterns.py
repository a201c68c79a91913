"""Users' patterns: every accepted one does in Spark what RE2 (in DuckDB) does, and what RE2 refuses is skipped."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions.patterns import SCRIPTS, CATEGORIES, pattern, replacement
from quire.operators import clean

TEXTS = [
    "ax 中文 y", "aBc 12\t34_x-é z　", "line\nline2\r\nend\n", "a.b[c]{2}(d)*+?|^$\\", "ÄÖ straße STRASSE ſ K", "foo.bar-baz foobar", "", "\n", "aaa{,2}b{3}c]", "x\x0by\x0cz\x07",
    "第三章 他说。Γειά мир ひらがな", "2024-01-31 n0 __ A1",
]
TAKEN = [
    r"(?P<a>x)", r"(?<name>x)\s", r"[[:alpha:]]+", r"[[:^alpha:]]", r"[^[:space:]]+", r"[[:word:]-]+", r"\p{Han}+", r"\p{^Han}", r"\P{Han}+", r"\pL+", r"\PL", r"[\p{Greek}\p{Cyrillic}a]+", r"[^\p{L}\d]",
    r"\Qa.b[c]\E", r"\Qa.b", r"\Q\E", r"line$", r"^line", r"(?m)^", r"(?m)$", r"(?m)^line\d?$", r"\Aline", r"end\n\z", r"a.b", r"(?s)e.l", r"(?i)strasse", r"(?i)k", r"(?i:FOO)bar", r"(?i)foo(?-i)bar",
    r"\bfoo\b", r"\Bbar", r"\w+", r"\W", r"\s+", r"\S+", r"[\s\d]+", r"[^\s]+", r"[\S]+", r"[\D]", r"\v", r"\f", r"\a", r"\t", r"\x41", r"\x{4e2d}", r"\101", r"\07", r"[]]", r"[^]a]", r"[a-]", r"[-a]", r"[a\-z]", r"[[a]",
    r"[a&&b]", r"a{,2}", r"b{3}", r"{", r"}", r"]", r"a{2}", r"a{2,}", r"a{1,2}?", r"(?U)a+", r"(?U)a+?", r"(a|b|)c", r"()", r"x*", r"(?:fo+){1,2}", r"\.", r"\_", r"\-", r"[\x00-\x1f]", r"^*l", r"(?i)[a-c]+", r"\p{Lu}", r"\p{Any}", r"[[:punct:]]",
    r"(?P<a_1>n)(?P<b2>\d)", r"\$", r"[^\n]*\n", r"é|中", r"[^a-zé]", r"\PN+", r"\d{4}-\d\d",
]
REFUSED = [
    "(unclosed", ")", "[a", "a**", "a*+", "a++", "a??*", "*a", "(*)", "|*", "(?=a)", "(?!a)", "(?<=a)", "(?<!a)", "(?>a)", r"\1", r"(a)\1", r"\h", r"\R", r"\X", r"\G", r"\Z", r"\p{IsHan}", r"\p{han}", r"\p{Foo}", r"\pX",
    "[z-a]", "[[:foo:]]", "a{1001}", "a{3,2}", "(?P<a>x)(?P<a>y)", "(?P<>x)", "(?P<a-b>x)", "(?x)a", "(?i", "\\", r"\x{110000}", r"\xg1", r"\8", r"\é", "a{2}{3}", r"[a-\d]", "(?P=a)", r"(?#c)a", r"\cA", r"\N", r"\中", "(?i-)a", "(a{999}){9}",
]


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


def test_taken_patterns_do_what_re2_does(spark, duck):
    found = {p: pattern(p) for p in TAKEN}
    assert [p for p, x in found.items() if x is None] == []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = df.select("i", *[F.regexp_replace("text", x.java, "").alias(f"p{k}") for k, x in enumerate(found.values())]).collect()
    wrong = []
    for r in got:
        for k, p in enumerate(TAKEN):
            older = p.replace("(?<name>", "(?P<name>")  # newer RE2 takes both
            want = duck.execute("SELECT regexp_replace(?, ?, '', 'g')", [TEXTS[r["i"]], older]).fetchone()[0]
            if r[f"p{k}"] != want:
                wrong.append((p, found[p].java, TEXTS[r["i"]], r[f"p{k}"], want))
    assert wrong == []


def test_what_re2_refuses_is_refused(duck):
    assert [p for p in REFUSED if pattern(p) is not None] == []
    # A nested count of more than 1000 is refused by Go's rule only; a name given twice is refused by RE2's, but not in DuckDB's build.
    known = {"(a{999}){9}", "(?P<a>x)(?P<a>y)"}
    taken = []
    for p in set(REFUSED) - known:
        try:
            duck.execute("SELECT regexp_replace('a', ?, '', 'g')", [p]).fetchone()
            taken.append(p)
        except duckdb.Error:
            pass
    assert taken == []


def test_all_classes_compile(spark, duck):
    names = sorted(SCRIPTS | CATEGORIES)
    row = spark.range(1).select(*[F.regexp_replace(F.lit("aé中"), pattern(rf"\p{{{n}}}").java, "").alias(n) for n in names]).first()
    for n in names:
        assert row[n] == duck.execute("SELECT regexp_replace('aé中', ?, '', 'g')", [rf"\p{{{n}}}"]).fetchone()[0], n


@pytest.mark.parametrize("p,template,want", [("(?P<a>[a-z])(b)", "$2${a}", "ba"), ("(a)(b)", "${1}0$$", "a0$"), ("(a)b", "$1x-$9-${no}", "--"), ("ab", r"\1 $ ${", r"\1 $ ${"), ("(a)(b)", "$0$0", "abab")])
def test_templates(spark, p, template, want):
    found = pattern(p)
    assert spark.range(1).select(F.regexp_replace(F.lit("ab"), found.java, replacement(template, found))).first()[0] == want


def test_operators_skip_bad_patterns(spark):
    df = spark.createDataFrame([(1, "ax 中文 y", ["(?P<a>x)", r"\p{IsHan}+", r"\h+", r"\Qy\E", "(bad", "[[:alpha:]]+", "", None]), (2, "t", None), (3, None, ["a"])], "doc_id int, text string, ad_blacklist array<string>")
    assert {r.doc_id: r.text for r in clean.ad_blacklist(df).collect()} == {1: " 中文 ", 2: "t", 3: None}
    rules = [("(bad", "x"), ("(?P<han>[[:alpha:]])x", "${han}!"), (r"\h", "?"), (r"\p{Han}", "汉")]
    got = {r.doc_id: (r.text, r.changed) for r in clean.apply_rules(df, rules).collect()}
    assert got == {1: ("a! 汉汉 y", True), 2: ("t", False), 3: (None, None)}
