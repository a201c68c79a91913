import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import whitening

SHAPE = "vec_id long, embedding array<double>, extra string"


def brute(vectors):
    """Per vector: deviation (exact), and the dense eigenpairs of the distinct ones."""
    x = [[int(np.floor(64 * c)) + 1000000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = (fit * n - sums).astype(float) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], n, values[::-1], basis[:, ::-1], np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in x])


def compare(rows, vectors, ids, components):
    deviation, n, values, basis, c = brute(vectors)
    at = {}
    for r in rows:
        at.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(at) == list(range(1, components + 1))
    for k, found in at.items():
        assert len(found) == len(ids)
        want = c @ basis[:, k - 1] / np.sqrt(values[k - 1])
        got = np.array([found[i].whitened for i in ids])
        sign = np.sign(want @ got)
        gap = min(abs(values[k - 1] - values[j]) for j in range(len(values)) if j != k - 1) / values[0]
        assert np.abs(got * sign - want).max() < 1e-11 / gap + 1e-9
        assert [found[i].deviation for i in ids] == deviation
        assert {r.n for r in found.values()} == {n}
        assert all(abs(r.explained - values[k - 1] / values.sum()) < 1e-10 for r in found.values())
        assert {r.identity_error for r in found.values()} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_equals_a_dense_solution(spark, sf_dir):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows = whitening.op12_embedding_whitening(spark, sf_dir).collect()
    compare(rows, [v for _, v in given], [i for i, _ in given], 16)


@pytest.mark.parametrize("d,spectrum", [(96, "flat"), (96, "steep"), (20, "flat")])
def test_spectra(spark, d, spectrum):
    rng = np.random.default_rng(d)
    width = np.ones(d) if spectrum == "flat" else 3.0 ** -np.arange(d).clip(0, 24)
    base = rng.normal(0, 1, (400, d)) * width * (0.2 if spectrum == "flat" else 40)
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate([*base, base[3], base[3], base[7]])]
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    model = whitening.fit(df)
    _, n, values, _, _ = brute([v for _, v, _ in rows])
    assert model.n == n == 400 and len(model.values) == 16
    assert np.abs(model.values - values[:16]).max() <= 1e-11 * values[0] and model.residual < 1e-11 and model.identity_error < 1e-4
    if spectrum == "flat":
        got = whitening.project(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).selectExpr("*", "k + 1 AS component", f"{model.n}L AS n", "0D AS explained", f"{model.identity_error}D AS identity_error").collect()
        assert len(got) == 16 * len(rows)


def test_no_covariance_but_passes_reach_the_driver():
    """The filter alone, on a matrix that is only applied: flat spectrum with a close pair at the edge of the wanted ones."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    values = np.sort(np.concatenate([[9.0, 8.0], np.linspace(4, 3, 298)]))[::-1]
    calls = []

    def apply(q):
        calls.append(q.shape[1])
        return basis @ (values[:, None] * (basis.T @ q))

    got, vectors, residual = whitening.eigenpairs(apply, 300, 16)
    assert np.abs(got - values[:16]).max() < 1e-11 and residual < 1e-11 and max(calls) <= 33
    assert np.abs(np.abs((basis[:, :16] * vectors).sum(axis=0)) - 1).max() < 1e-9


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0], "a"), (1, [0.5, 1.0], "b"), (None, [0.25, -1.0], "c"), (3, None, "d"), (4, [nan, 0.0], "e"), (5, [inf, 0.0], "f"), (6, [None, 0.0], "g"), (7, [], "h"), (8, [1.0, 2.0, 3.0], "i"), (9, [0.75, 0.0], "j")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("whitened", F.lit(1)).withColumn("key", F.lit(2)).withColumn("deviation", F.lit(3))
    model = whitening.fit(df)
    assert model.n == 3 and model.sums == [3000000 + 32 + 16 + 48, 3000000 + 64 - 64] and len(model.values) == 2
    got = whitening.project(df, model).collect()
    assert sorted((str(r.vec_id), len(r.whitened)) for r in got) == [("1", 2), ("1", 2), ("9", 2), ("None", 2)]
    for none in (df.limit(0), df.filter("vec_id in (3, 4, 5, 6, 7)")):
        assert whitening.fit(none) is None
    assert len(whitening.fit(df.filter("vec_id = 1")).values) == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "") for i in range(9)], SHAPE)
    assert len(whitening.fit(line).values) == 1


def test_huge_entries_and_deviations_over_a_long(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], ""), (2, [-1e300, 0.0], ""), (3, [0.0, 0.5], "")], SHAPE)
    model = whitening.fit(df)
    assert {r.vec_id: r.deviation is None for r in whitening.project(df, model).collect()} == {1: True, 2: True, 3: False}
    x = np.array([[3037000500], [3037000499], [0]]) // 1
    assert whitening.deviations(x, 1, [0]) == [None, 3037000499**2, 0]


def test_an_empty_table_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.op12_embedding_whitening(spark, str(tmp_path))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0
