import itertools
import re
from re import _constants as sre
from re import _parser as parser

from quire.llm import licenses
from quire.llm.license_rules import ANCHORS, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places, labels = WORD.findall(low), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def naive_labels(text):
    """Every rule everywhere, then each pair of spans."""
    norm = " " + " ".join(WORD.findall((text or "").lower())) + " "
    found = []
    for i, (p, label, _, regex) in enumerate(rules()):
        for m in re.finditer(f" (?:{regex})(?= )", norm):
            start = norm[: m.start()].count(" ")
            found.append((start, start + m.group().count(" "), p, i, label))
    keep = [d for d in found if not any(e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in found)]
    return {d[4] for d in keep}


TEXTS = [
    None, "", "  ", "CC BY", "cc-by 4.0 cc by cc by", "the GNU General Public License v3 or later", "All rights reserved. ALL  RIGHTS-reserved all rights",
    "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0 (the \"License\")", "general public general public license license",
    "https://creativecommons.org/licenses/by-nc/4.0/ Creative Commons Attribution-NonCommercial 4.0", "éa cc by ü all rights reserved", "\U0001F600 cc by",
    "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy", "Copyright (c) 2020 X. All rights reserved. " * 50,
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "CC BY"), (None, "cc by")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).createOrReplaceTempView("lic_docs")
    df = licenses.scan(spark.table("lic_docs")).collect()
    assert len(df) == len(rows)
    for r in df:
        n, total, first, last, labels = brute(r.text)
        base = r.base
        assert r.n_words == n and sum(b.n for b in base) == total, r.text
        assert min((b.first for b in base), default=None) == first and max((b.last for b in base), default=None) == last
        assert ",".join(sorted(b.label for b in base)) == labels
        assert {d.label for d in r.detections} == naive_labels(r.text), r.text


def test_empty_table_and_clashing_names(spark):
    names = ["norm_", "found_", "row_", "base_0", "base_1", "start", "rule"]
    text = "Licensed under the Apache License, Version 2.0. CC BY"
    rows = [(1, text, *"abcdefg", "x", 5, [1])]
    shape = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names) + ", n_words string, base int, detections array<int>"
    df = spark.createDataFrame(rows, shape)
    got, plain = licenses.scan(df).first(), licenses.scan(df.select("doc_id", "text")).first()
    assert [got[n] for n in names] == list("abcdefg") and licenses.scan(df).columns == ["doc_id", "text", *names, "n_words", "base", "detections"]
    assert (got.n_words, got.base, got.detections) == (plain.n_words, plain.base, plain.detections) and got.n_words == 10 and got.detections
    assert licenses.scan(df.limit(0)).count() == 0


def test_rules_are_reachable():
    assert len(rules()) > 200
    for _, _, word, regex in rules():
        re.compile(regex)
        assert any(a.strip() in f" {word}" or a.strip() in f" {regex}" for a in ANCHORS), (word, regex)


def written(tokens):
    """Texts for every alternative of a parsed regex."""
    parts = []
    for op, arg in tokens:
        if op is sre.LITERAL:
            parts.append([chr(arg)])
        elif op is sre.NOT_LITERAL:
            parts.append(["x"])
        elif op is sre.IN:
            parts.append([chr(a if o is sre.LITERAL else a[1]) for o, a in arg])
        elif op is sre.SUBPATTERN:
            parts.append(written(arg[3]))
        elif op is sre.BRANCH:
            parts.append([t for x in arg[1] for t in written(x)])
        else:
            least, most, item = arg
            times = {least, min(most, least + 1)}
            parts.append([t for n in times for t in map("".join, itertools.product(written(item), repeat=n))])
    return list(map("".join, itertools.product(*parts)))


def test_every_alternative_of_every_rule_passes_the_gates(spark):
    texts = sorted({t.strip() for *_, regex in rules() for t in written(parser.parse(regex))})
    assert {"gpl v2", "lgpl 2 1", "agpl 3", "cc0 1 0 universal", "mulan psl v2", "mit no attribution", "all rights are reserved", "see the license", "academic purposes only"} <= set(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for r in licenses.scan(df).collect():
        found = {d.label for d in r.detections}
        assert found and found == naive_labels(r.text), r.text
