"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers, x = floor(64 c) + 1000000. The covariance V of the distinct ones is never built: each step applies it to a
block Q as a distributed pass of Xc'(Xc Q) / n over the centred rows, and only d x k sums reach the driver. A polynomial of
Chebyshev recurrences damps the unwanted part of the spectrum, QR and Rayleigh-Ritz give the pairs, and the iteration ends when the
residuals of all wanted pairs are at rounding level. The spectrum's lower end, which sets the damped interval, comes from Lanczos
steps on one more column of the first filter's passes.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are rows whose vector has not the
table's commonest length (of equally common ones the longest). x is clipped to +-2^52. Rows that repeat an id are rows of
their own. Components whose eigenvalue is zero to rounding (fewer distinct vectors or dimensions than components) are left out, so
an empty table, or one distinct vector, gives no row. deviation is null where it does not fit a long. Null ids stay null.
Columns other than the key and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import released, stored, table

COMPONENTS = 16
#: More columns than wanted: the filter then has to damp only what lies below the last of them.
GUARD = 16
DEGREE = 12
#: The damped part may fall behind the largest eigenvalue by so much in one filter; more would cost the smaller ones their digits.
MOST_SPREAD = 1e9
#: A pair is certified if its residual is below this share of the largest eigenvalue; what no longer falls and is below STALLED is at rounding level.
CERTIFIED, STALLED, MOST_ROUNDS = 2e-14, 1e-11, 200
#: An eigenvalue below this share of the largest one is zero.
ZERO = 1e-11
# How an entry becomes an integer.
SCALE, SHIFT = 64.0, 1_000_000
CLIP = 1 << 52


@dataclass
class Whitening:
    """n distinct vectors with sums by dimension; eigenpairs of their covariance, its trace, and how far whitening is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int
    residual: float


def usable(vec: Column) -> Column:
    bad = F.exists(vec.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(rows: DataFrame, vec: str, key: str | None = None) -> tuple[DataFrame, int]:
    """The usable rows as (key, x: d longs as bytes), and d. A null key stays."""
    good = rows.filter(usable(F.col(vec)))
    lengths = good.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    kept = [F.col(key).alias("key")] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            x = np.clip(np.floor(SCALE * c) + SHIFT, -CLIP, CLIP).astype("<i8")
            raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(np.arange(len(batch) + 1, dtype=np.int32) * (8 * d)), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("key"), raw] if key else [raw], names=["key", "x"] if key else ["x"])

    same = good.filter(F.size(vec) == d).select(*kept, F.col(vec).cast("array<double>").alias("vec"))
    shape = (f"key {rows.schema[key].dataType.simpleString()}, " if key else "") + "x binary"
    return same.mapInArrow(released(run), shape), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """n x d longs of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def summed(points: DataFrame, d: int, cells: int, part) -> np.ndarray:
    """The sum of part(rows) over all batches of rows: each task adds up its own, and Spark adds the tasks' cells by groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += part(matrix(batch.column("x"), d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    out = np.zeros(cells)
    for r in points.mapInArrow(released(run), "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # d x k cells
        out[r["cell"]] = r["v"]
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles: whole parts are taken off as integers first, so nothing is lost."""
    whole = np.array([s // n for s in sums])
    rest = np.array([(s - n * int(w)) / n for s, w in zip(sums, whole)])
    return (x - whole).astype(np.float64) - rest


def chebyshev(apply, q: np.ndarray, degree: int, low: float, high: float, probe: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """q under the Chebyshev polynomial that is small on [low, high]; one pass a degree. With a start vector `probe`, Lanczos steps
    share the passes, and a lower bound of the spectrum comes with the block (else `low` itself)."""
    half, centre = (high - low) / 2, (high + low) / 2
    scale = first = half / (low - centre) if half else -1.0
    alphas, betas, basis = [], [], []
    before, now = np.zeros_like(q), q
    for step in range(degree):
        block = now if probe is None else np.column_stack([now, probe])
        image = apply(block)
        if probe is not None:
            basis.append(probe)
            alphas.append(float(probe @ image[:, -1]))
            rest = image[:, -1] - np.column_stack(basis) @ (np.column_stack(basis).T @ image[:, -1])
            rest -= np.column_stack(basis) @ (np.column_stack(basis).T @ rest)
            betas.append(float(np.linalg.norm(rest)))
            probe, image = (rest / betas[-1] if betas[-1] > 1e-12 * abs(alphas[0]) else None), image[:, :-1]
        moved = image - centre * now
        if step == 0:
            before, now = now, moved * (first / half)
        else:
            following = 1 / (2 / first - scale)
            before, now, scale = now, moved * (2 * following / half) - before * (scale * following), following
    bound = low
    if alphas:
        m = len(alphas)
        values, tops = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: m - 1], 1) + np.diag(betas[: m - 1], -1))
        bound = max(low, float(values[0] - betas[-1] * abs(tops[-1, 0])))
    return now, bound


def growth(value: float, low: float, high: float) -> float:
    """log of the factor by which one degree raises an eigenvalue above the interval, against those within."""
    at = (value - (high + low) / 2) / max((high - low) / 2, 1e-300)
    return float(np.arccosh(max(1.0, at)))


def eigenpairs(apply, d: int, wanted: int, guard: int = GUARD, degree: int = DEGREE, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, their vectors, and the largest residual as a share of the first value. `apply` is V times a block."""
    k = min(d, wanted + guard)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0] if k < d else np.eye(d)
    low, best, rounds = 0.0, np.inf, 0
    while True:
        image = apply(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        count = min(wanted, k)
        top = max(float(values[0]), 1e-300)
        worst = float(np.linalg.norm(image[:, :count] - q[:, :count] * values[:count], axis=0).max()) / top
        rounds += 1
        if k == d or values[0] <= 0 or worst <= CERTIFIED or (worst <= STALLED and worst > best / 2):
            return values[:count], q[:, :count], worst
        if rounds > MOST_ROUNDS:
            raise RuntimeError(f"residual {worst} after {rounds} filters")
        best = min(best, worst)
        high = max(float(values[-1]), low + 1e-9 * top)
        spread = growth(top, low, high)
        steps = degree if spread * degree <= np.log(MOST_SPREAD) else max(2, int(np.log(MOST_SPREAD) / spread))
        probe = rng.standard_normal(d) if rounds == 1 else None
        filtered, bound = chebyshev(apply, q, steps, low, high, None if probe is None else probe / np.linalg.norm(probe))
        low = 0.98 * bound if rounds == 1 else low
        # Twice is enough: columns that filtering made nearly parallel are then orthogonal to rounding.
        q = np.linalg.qr(np.linalg.qr(filtered)[0])[0]


def fit(rows: DataFrame, vec: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of rows; None if there is none."""
    points, d = integers(rows, vec)
    if not d:
        return None
    points = stored(points.distinct(), "distinct-vectors")

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column("x"), d)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, (x // 2).sum(axis=0) * 2 + (x % 2).sum(axis=0))] if np.abs(x).max(initial=0) * len(x) < 2**61 else [a + sum(map(int, c)) for a, c in zip(total, x.T)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(n), *map(str, total)])], names=["cell", "v"])

    exact = {r["cell"]: int(r["v"]) for r in points.mapInArrow(released(sums_of), "cell int, v string").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    n, sums = exact[-1], [exact[i] for i in range(d)]
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        part = lambda x: (c := centred(x, n, sums)).T @ (c @ q)
        return summed(points, d, d * q.shape[1], part).reshape(d, -1) / n

    trace = float(summed(points, d, d, lambda x: (centred(x, n, sums) ** 2).sum(axis=0)).sum() / n)
    values, vectors, residual = eigenpairs(apply, d, components)
    kept = values > ZERO * max(float(values[0]), 0.0) if trace > 0 else np.zeros(len(values), bool)
    values, vectors = values[kept], vectors[:, kept]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    r = len(values)
    if r:
        white = lambda x: (w := centred(x, n, sums) @ vectors / np.sqrt(values)).T @ w
        error = float(np.abs(summed(points, d, r * r, white).reshape(r, r) / n - np.eye(r)).max())
    return Whitening(n, sums, values, vectors, trace, error if r else 0.0, passes, residual)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum (n x - S)^2 by row, exactly; None where that is over a long. Products wrap around, which is exact for what fits."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    about = ((centred(x, n, sums) * float(n)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        scaled = (x - np.array(whole)) * np.int64(n) - np.array(rest)
        exact = (scaled * scaled).sum(axis=1)
    large = lambda row: (v if (v := sum((n * int(a) - s) ** 2 for a, s in zip(row, sums))) < 1 << 63 else None)
    return [int(e) if a < 9e18 else None if a > 1e19 else large(row) for e, a, row in zip(exact, about, x)]


def project(rows: DataFrame, model: Whitening, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(key, deviation, whitened: array<double>) of each usable row; whitened has a value for each component, in their order."""
    points, d = integers(rows, vec, key)
    n, sums, basis = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), d)
            white = centred(x, n, sums) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * basis.shape[1]), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(deviations(x, n, sums), pa.int64()), lists], names=[key, "deviation", "whitened"])

    return points.mapInArrow(released(run), f"`{key}` {rows.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component. SQL has no eigenvectors; tests compare with a dense solution of the whole covariance."""
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    if model is None or not len(model.values):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    one = project(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
