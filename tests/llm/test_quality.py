import zlib

import numpy as np

from quire.llm import quality


def test_scores_are_those_of_two_normal_densities():
    rng = np.random.default_rng(0)
    d = len(quality.NAMES)
    xs = [rng.normal(c, 1 + c, (300, d)) for c in (0, 1)]
    n = np.array([300.0, 300.0])
    m = quality.Discriminant(n, np.stack([x.sum(axis=0) for x in xs]), np.stack([x.T @ x for x in xs]))
    pooled = np.maximum(quality.FLOOR, sum(x.var(axis=0) for x in xs) / 2)
    probe = rng.normal(0.5, 1, (20, d))
    logs = []
    for x in xs:
        s = (1 - quality.SHRINKAGE) * np.cov(x.T, bias=True) + np.diag(quality.SHRINKAGE * pooled + quality.FLOOR)
        diff = probe - x.mean(axis=0)
        logs.append(-0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff)))
    assert np.allclose(m.scores(probe), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_edge_cases(spark):
    texts = [None, "", " \n ", "word", "A" * 100000, "x y " * 100000, "é ü", "!!! ###"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, None, "k"), (None, "t", "k")], "doc_id long, text string, score string")
    none = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    one = quality.train(df, spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id long, quality int"))
    for model, want in ((none, 0.5), (one, 1.0)):
        assert [r.score for r in quality.score(df, model).collect()] == [want] * (len(texts) + 2)
    both = quality.train(df, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.score(df, both).collect())
    assert quality.score(df.limit(0), both).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op1_quality_qda(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.95


def test_query_equals_an_independent_fit(spark, sf_dir):
    """Every score of the query against numpy on all rows: who is learned from, the classes' moments, shrinkage and densities."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    x = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs}
    fit = [np.stack([x[i] for i, y in labels.items() if y == c and i in x and not held[i]]) for c in (0, 1)]
    total = sum(map(len, fit))
    assert total < quality.TRAINING_ROWS  # so the bounded sample is all of them
    pooled = np.maximum(quality.FLOOR, sum(len(f) / total * f.var(axis=0) for f in fit))
    every = np.stack([x[r.doc_id] for r in docs])
    logs = []
    for f in fit:
        s = (1 - quality.SHRINKAGE) * np.cov(f.T, bias=True) + np.diag(quality.SHRINKAGE * pooled + quality.FLOOR)
        diff = every - f.mean(axis=0)
        logs.append(np.log(len(f) / total) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff)))
    want = dict(zip((r.doc_id for r in docs), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))))
    got = quality.op1_quality_qda(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == held[r.doc_id] and abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == int(r.score >= 0.7)
