import re
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.test_jaccard import brute

import corpus_pipeline
from quire.llm import mixing, packing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "src0", 0), (900002, "", "en", "src1", 0), (900003, "123 !!", None, None, 6)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.limit(3)).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    said = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs_out = rows_of(docs), stage(spark, docs, SF).cache()
        after = rows_of(docs_out)
        assert docs_out.columns == docs.columns and docs_out.dtypes == docs.dtypes
        said[name] = after
        if name == "language_id":
            assert {k for k, _ in before} - {k for k, _ in after} == {900001, 900002, 900003}
        elif name == "quality_classifier":
            gone = {k for k, _ in before} - {k for k, _ in after}
            assert all(labels[k] == 0 for k in gone if k in labels) and sum(labels.get(k) == 0 for k, _ in after) <= 1
        elif name == "ngram_jaccard_join":
            want = Counter(c for _, n, c in brute(before))
            assert set(want) == {k for k, _ in after} and len(after) == len(want)
        else:
            size = {k: len(WORD.findall(t)) for k, t in before}
            taken = Counter()
            for k, t in after:
                taken[k] += len(WORD.findall(t))
            want = {r.doc_id: r.taken for r in mixing.mix(docs.select("doc_id", "source", mixing.words_of(F.col("text")).alias("size"))).collect()}
            assert all(taken[k] == n for k, n in want.items()) and all(n <= 3 * size[k] for k, n in taken.items())
        docs = docs_out
    got = corpus_pipeline.packed(spark, docs, SF).toPandas()
    w = packing.words()
    assert got.length.sum() == sum(len(w.ids(t)) // 4 + 1 for _, t in said["source_mixing"])
    assert got.groupby("sequence_id").length.sum().max() <= 1024


def test_run_and_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
