import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import graph, neardup


def brute(rows, cosine=0.93):
    """rows (vec_id, vector, label) -> (vec_id, n_links, component_id), in the order of rows."""
    n = len(rows)
    x = [neardup._vectors(__import__("pyarrow").array([v]))[0] if label is not None else None for _, v, label in rows]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(root(i), rows[i][0])) for i in range(n)]


def fixture(seed=0, n=300, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v = base + rng.normal(0, rng.choice([0, 0.02, 0.2, 0.33]), d)
        else:
            v = rng.normal(0, 1, d)
        rows.append((i, [float(a) for a in v], int(rng.integers(2))))
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted(map(tuple, neardup.near_duplicates(df, **options).collect()), key=str)


def test_many_tables_find_all(spark):
    rows = fixture()
    assert run(spark, rows, tables=40, probes=4) == sorted(brute(rows), key=str)


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 1, 16)
    rows = [(i, [float(a) for a in centre + rng.normal(0, 0.05, 16)], 1) for i in range(150)] + [(i, rows_, 1) for i, rows_ in [(900, [float(a) for a in centre])] * 5]
    want = sorted(brute(rows), key=str)
    for block in (512, 60, 20):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert run(spark, rows, tables=8) == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None)]
    rows += [(9, [1.0, 0.0], 1), (10, [2.0, 0.0], 1), (9, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (None, [1.0, -0.0], 1), (13, [1.0, 0.0], 2), (None, [0.0, 5.0], 2), (14, [1e200, 1.0], 1)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, rows[:0]) == []


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(0, 1, (5, 32))
    y = neardup.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(neardup.hadamard(y), x)


def test_components(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(1 << 40)[:0] if False else rng.integers(0, 1 << 60, 200)
    edges = [(int(ids[i]), int(ids[i + 1])) for i in range(100)] + [(int(ids[120]), int(ids[i])) for i in range(121, 160)] + [(int(ids[5]), int(ids[5]))]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[int(i)] for i in ids[:101]}) == 1 and len({got[int(i)] for i in ids[120:160]}) == 1 and len(got) == 141
    assert got[int(ids[0])] != got[int(ids[120])]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = neardup.op5_embedding_neardup(spark, sf).toPandas().set_index("vec_id")
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").toPandas()
    found = want = 0
    for _, part in rows.groupby("label"):
        x = np.stack(part.embedding)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.93).sum(axis=1) - 1
        mine = got.loc[part.vec_id].n_links.to_numpy()
        assert (mine <= near).all()
        found, want = found + mine.sum(), want + near.sum()
    assert found >= 0.97 * want


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
@pytest.mark.parametrize("d", [64, 256])
def test_recall_stays_with_more_hashes(hashes, d):
    """Pairs right at the threshold share a bucket, whatever the number of hashes."""
    rng = np.random.default_rng(hashes)
    n, (tables, probes) = 1500, neardup.index_shape(hashes)
    x, y = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = (neardup.bucket_keys(v, hashes, tables, probes).reshape(n, tables, probes) for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * y))
    assert (a[..., None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.99


def test_cosines_of_huge_and_tiny_vectors(spark):
    """Squares that over- or underflow are no reason to leave a vector out."""
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 1e190], 1), (3, [1e-200, 0.0], 2), (4, [1e-200, 1e-210], 2), (5, [0.0, 0.0], 1), (6, [3.0, 0.0], 1)]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == {1: (2, 1), 2: (2, 1), 6: (2, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
