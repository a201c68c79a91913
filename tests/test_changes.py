"""Change records: cleaning with records equals cleaning, undoing gives the text back, and places are what a plain replay finds."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from quire.functions.text import JAVA_WHITE, WHITE
from quire.operators import changes, clean
from quire.plans.views import view

EXTRA = [
    (-1, None), (-2, ""), (-3, "&amp;lt;&nbsp;&nbsp;x"), (-4, "锟斤拷锟斤拷a烫烫烫烫烫烫b���"), (-5, "臺灣西,臺灣.  \n\n\n\n 國\r\n\r\rx \t "), (-6, "www.a.comwww.b.com https://x 本文由某某提供本文由他提供\nQQ群:1 x"), (-7, "&#8203;" * 50 + "，"), (-8, "😀&lt;😀,中" * 3),
]


def docs(spark, sf_dir):
    return view(spark, sf_dir, "seeded").select("doc_id", "text").unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string"))


def test_undoing_restores_every_text(spark, sf_dir):
    df = docs(spark, sf_dir)
    logged = changes.logged(df)
    given = {r.doc_id: r.text for r in df.collect()}
    assert {r.doc_id: r.text for r in logged.select("doc_id", "text").collect()} == {r.doc_id: r.text for r in clean.basic_clean(clean.preprocess(df)).collect()}
    back = changes.undone(logged).select("doc_id", "text", "changes").collect()
    assert {r.doc_id: r.text for r in back} == given
    for r in back:
        for c in r.changes:
            # A hit that no earlier step had touched stands in the given text where its record says.
            assert 0 <= c.source_position <= len(given[r.doc_id])
            if c.step == min(x.step for x in r.changes):
                assert given[r.doc_id][c.source_position :].startswith(c.original) and c.position == c.source_position
    kinds = {c.kind for r in back for c in r.changes}
    assert kinds == {"garbled", "control", "advertisement", "whitespace", "html_entity", "punctuation", "traditional"}
    assert {c.confidence for r in back for c in r.changes if c.kind == "garbled"} == {1.0}


def test_places_against_a_character_by_character_replay():
    rng = random.Random(4)
    for _ in range(200):
        text = [(chr(97 + rng.randrange(3)), i) for i in range(rng.randint(0, 40))]  # each character knows where it came from
        step, gap, before, after, want = [], [], [], [], []
        for s in range(1, 5):
            out, i, last = [], 0, 0
            while i < len(text):
                n = rng.choice([0, 0, 0, 1, 2, 3])
                n = min(n, len(text) - i)
                if not n:
                    out.append(text[i])
                    i += 1
                    continue
                m = rng.randrange(4)
                step.append(s)
                gap.append(i - last)
                before.append(n)
                after.append(m)
                want.append((i, text[i][1]))
                out += [("x", text[i][1])] * m
                i += n
                last = i
            text = out
        here, source = changes.places_of(*(np.array(c, np.int64) for c in (step, gap, before, after)))
        assert list(zip(here.tolist(), source.tolist())) == want


def test_classes_for_java_find_the_same_and_soon(spark):
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F610)]))
    pairs = [(f"[{clean.TRADITIONAL}]", changes.one_of(clean.TRADITIONAL)), (WHITE, JAVA_WHITE)]
    df = spark.createDataFrame([(every,)], "text string")
    for plain, fast in pairs:
        a, b = (df.select(F.regexp_extract_all("text", F.lit(p), F.lit(0))).first()[0] for p in (plain, fast))
        assert a == b and len(a) > 20
    [step] = [s for s in changes.ALL if s.kind == "traditional"]
    text, seconds = "some plain words, " * 200_000, []
    for p in (step.pattern, step.java):
        found = spark._jvm.java.util.regex.Pattern.compile(p)
        least = []
        for _ in range(3):
            began = time.perf_counter()
            assert not found.matcher(text).find()
            least.append(time.perf_counter() - began)
        seconds.append(min(least))
    assert seconds[1] < seconds[0] / 3
