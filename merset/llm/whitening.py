"""Whitening of vectors by the leading components of their covariance.

Spark sums the covariance exactly, in integers. Its leading eigenvectors come
from FEAST: the spectrum is cut into intervals; for each, a quadrature along a
contour around it solves the shifted matrix at complex points (each point a row
of a Spark job) and so projects a block of vectors onto what lies inside;
Rayleigh-Ritz takes the components out of the block. The inertia of the shifted
matrix says how many an interval holds, so none can be missed unseen. (Polizzi,
Density-matrix-based Algorithm for Solving Eigenvalue Problems, 2009.)
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.session import cut, spread

#: Entries are held within plus and minus this before the offset, so that integer sums can be exact.
MOST = 1 << 27
#: Points on the upper half of a contour, and eigenvalues of an interval, about.
POINTS, HELD = 8, 4
#: Eigenvalues up to this share of the trace count as zero.
NOUGHT = 1e-12


class Components(NamedTuple):
    """n, sums of each dimension, eigenvalues (falling), eigenvectors (columns) and the covariance's trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, offset: int) -> DataFrame:
    """vec_id, x: the sound vectors of the commonest length, as integers."""
    e = F.col(embedding)
    sound = vectors.where(e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    limit = float(MOST)
    whole = lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c.cast("double") * scale))) + F.lit(offset)
    rows = cut(spread(sound.select(F.col(vec_id).alias("vec_id"), e.alias("e"))).select("vec_id", F.transform("e", whole).alias("x")), "integers")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("x") == (common[0]["d"] if common else 0))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _scatter(centre: np.ndarray):
    """Vectors to (place, value): sums of products of their centred entries over the task, a row of the upper triangle's entry each; exact."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        held, room = np.zeros((d, d), np.int64), 1 << 62
        for batch in batches:
            y = _rows(batch.column(0), d) - centre
            if not len(y):
                continue
            most = int(np.abs(y).max()) ** 2 * len(y)
            if most < 1 << 53:  # doubles are exact
                part = (y.T.astype(float) @ y.astype(float)).astype(np.int64)
            else:
                part = y.astype(object).T @ y.astype(object)
            if most >= room:
                total, held, room = total + held, np.zeros((d, d), np.int64), 1 << 62
            if most >= 1 << 53:
                total = total + part
            else:
                held, room = held + part, room - most
        total = total + held
        yield pa.record_batch({"place": pa.array(np.arange(len(upper[0])), pa.int32()), "value": pa.array([Decimal(int(v)) for v in total[upper]], pa.decimal128(38, 0))})

    return run


def covariance(x: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of each dimension, and the covariance (divisor n) of the integer vectors x, each entry rounded once."""
    row = x.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, sums = row["n"], [int(row[f"s{i}"]) for i in range(d)]
    centre = [round(s / n) for s in sums]
    parts = x.select("x").mapInArrow(_scatter(np.array(centre, np.int64)), "place int, value decimal(38,0)")
    found = {r["place"]: int(r["v"]) for r in parts.groupBy("place").agg(F.sum("value").alias("v")).collect()}
    off = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for place, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        v[i, j] = v[j, i] = (n * found[place] - off[i] * off[j]) / (n * n)
    return n, sums, v


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of a - shift, by symmetric elimination with pivots of one or two rows (Bunch and Parlett)."""
    a = a - shift * np.eye(len(a))
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        beside = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(beside.argmax()), a.shape)
        if diagonal[i] == 0 and beside[p, q] == 0:
            break
        pivot = [i] if diagonal[i] >= 0.64 * beside[p, q] else [int(p), int(q)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block = a[np.ix_(pivot, pivot)]
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1  # a pivot of two rows has one eigenvalue of each sign
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return above


def intervals(a: np.ndarray, wanted: int, top: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of intervals that hold the ``wanted`` largest eigenvalues of a, all above zero; top is above all of them."""
    finest = 1e-13 * top
    low, high = NOUGHT * top, top
    n_low = count_above(a, low)
    while n_low > wanted and high - low > finest:  # low rises until just the wanted ones are above it
        mid = (low + high) / 2
        n = count_above(a, mid)
        low, high, n_low = (mid, high, n) if n >= wanted else (low, mid, n_low)
    out, open_ = [], [(low, top, n_low, 0)]
    while open_:
        low, high, n_low, n_high = open_.pop()  # so many are above each end
        if n_low == n_high:
            continue
        mid = (low + high) / 2
        if n_low - n_high > HELD and high - low > finest:
            n = count_above(a, mid)
            open_ += [(low, mid, n_low, n), (mid, high, n, n_high)]
        else:
            # shrunk to what is inside, or the contour would be much larger than it
            while high - low > finest and (n := count_above(a, mid)) in (n_low, n_high):
                low, high = (low, mid) if n == n_high else (mid, high)
                mid = (low + high) / 2
            out.append((low, high, n_low - n_high))
    return out


def _project(spark: SparkSession, a: np.ndarray, contours: list[tuple[float, float]], blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each block of vectors, projected onto the eigenvalues within its contour; every quadrature point is a row, solved in a task of its own."""
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    points = [(i, float(np.pi / 2 * (1 - t)), float(w)) for i in range(len(contours)) for t, w in zip(nodes, weights, strict=True)]
    shared = spark.sparkContext.broadcast((a, contours, blocks))  # the square of the dimensions, and as many columns as components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, contours, blocks = shared.value
        for batch in batches:
            at, out = batch.column(0).to_pylist(), []
            for i, angle, w in zip(at, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                low, high = contours[i]
                turn = (high - low) / 2 * np.exp(1j * angle)
                solved = np.linalg.solve(((low + high) / 2 + turn) * np.eye(len(a)) - a, blocks[i].astype(complex))
                out.append((w / 2 * (turn * solved).real).tobytes())
            yield pa.record_batch({"contour": pa.array(at, pa.int32()), "part": pa.array(out, pa.binary())})

    rows = spark.createDataFrame(points, "contour int, angle double, weight double").repartition(len(points)).mapInArrow(run, "contour int, part binary")
    parts: list[np.ndarray] = [np.zeros(b.shape) for b in blocks]
    for r in rows.orderBy("contour", "part").collect():  # a sum in one order, so that reruns agree
        parts[r["contour"]] += np.frombuffer(r["part"]).reshape(parts[r["contour"]].shape)
    shared.unpersist()
    return parts


def _ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values (rising) and vectors of the space that a block spans."""
    q = np.linalg.qr(block)[0]
    small = q.T @ a @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turn


def leading(spark: SparkSession, a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above zero (falling), fewer if there are fewer, and their unit eigenvectors, of a symmetric matrix without negative ones.

    A contour's block is made larger until as many Ritz pairs inside have
    converged as the inertia says are there; a block of all dimensions always has.
    """
    d, top = len(a), float(np.trace(a)) * (1 + 1e-9)
    rng = np.random.default_rng(13)
    open_ = [(low, high, n, rng.standard_normal((d, min(d, 2 * n + 4)))) for low, high, n in intervals(a, wanted, top)] if top > 0 else []
    done: list[np.ndarray] = []
    tries = 0
    while open_:
        tries += 1
        # a little beyond the interval, so that its ends are well inside
        contours = [(low - 0.05 * (high - low) - 1e-13 * top, high + 0.05 * (high - low) + 1e-13 * top) for low, high, _, _ in open_]
        again = []
        for (low, high, n, block), projected in zip(open_, _project(spark, a, contours, [o[3] for o in open_]), strict=True):
            values, vectors = _ritz(a, projected if np.isfinite(projected).all() else block)
            off = np.linalg.norm(a @ vectors - vectors * values, axis=0)
            slack = 1e-12 * top
            inside = (values > low - slack) & (values <= high + slack) & (off <= 1e-14 * np.sqrt(d) * top)
            if inside.sum() >= n:
                done.append(vectors[:, inside])
            elif vectors.shape[1] == d:
                done.append(vectors[:, np.argsort(np.abs(values - (low + high) / 2))[:n]])
            else:
                more = min(d, 2 * vectors.shape[1]) - vectors.shape[1] if tries % 4 == 0 else 0
                again.append((low, high, n, np.hstack([vectors, rng.standard_normal((d, more))])))
        open_ = again
    if not done:
        return np.zeros(0), np.zeros((d, 0))
    values, vectors = _ritz(a, _spanning(np.hstack(done)))
    order = np.argsort(-values, kind="stable")[: min(wanted, int((values > NOUGHT * top).sum()))]
    return values[order], vectors[:, order]


def _spanning(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal columns of the same space; what neighbouring intervals found twice counts once."""
    u, s, _ = np.linalg.svd(vectors, full_matrices=False)
    return u[:, s > 0.1]


def fit(x: DataFrame, components: int) -> Components:
    """The leading components of integer vectors x, all of one length."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return Components(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums, v = covariance(x, first["d"])
    trace = float(np.trace(v))
    values, vectors = leading(x.sparkSession, v / trace if trace else v, components)
    return Components(n, sums, values * trace, vectors, trace)


def _whiten(model: Components):
    n, d = model.n, len(model.sums)
    centre = np.array([round(s / n) for s in model.sums], np.int64)
    off = np.array([s - n * int(c) for s, c in zip(model.sums, centre, strict=True)], np.int64)
    turn = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _rows(batch.column(1), d) - centre
            w = (y - off / n) @ turn
            near = ((float(n) * y - off) ** 2).sum(1)
            with np.errstate(over="ignore"):
                exact = ((n * y - off) ** 2).sum(1)
            told = [int(e) if f < 9.2e18 else None for e, f in zip(exact, near, strict=True)]
            for i in np.flatnonzero((near >= 9.2e18) & (near < 9.3e18)):
                whole = sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[i], off, strict=True))
                told[i] = whole if whole < 1 << 63 else None
            at = pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32())
            yield pa.record_batch([batch.column(0), pa.array(told, pa.int64()), pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component.

    Kept are vectors without null, NaN and infinite entries, of the length
    that most of them have (of equally common ones the shortest); null and empty
    ones are not. An entry c becomes x = floor(scale * c) + offset, where
    scale * c is held within plus and minus 2 ** 27. The covariance has the
    divisor n. There are fewer components where fewer eigenvalues are above
    1e-12 of the trace (so none, and no rows, if all vectors are equal).

    deviation is the sum over dimensions of (n * x - sum) ** 2, exact, and null
    beyond BIGINT, as sums over very many rows are. identity_error is measured on the whitened
    values. Rows that repeat, and rows with a null or repeated id, each count
    and are returned. Other columns are not read. The driver and each task hold
    a matrix of dimensions squared.
    """
    x = _integers(vectors.select(vec_id, embedding), vec_id, embedding, scale, offset)
    kind = x.schema["vec_id"].dataType.simpleString()
    model = fit(x, components)
    k = len(model.values)
    if not k:
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    rows = cut(x.mapInArrow(_whiten(model), f"vec_id {kind}, deviation bigint, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    mean = rows.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("w")[i] - F.lit(mean[i]) for i in range(k)]
    error = max(abs(v - (i == j)) for v, (i, j) in zip(rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first(), pairs, strict=True))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
