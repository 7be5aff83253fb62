"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation with full reorthogonalisation.

Entries become whole numbers floor(64 c) (the contract's added million cancels in everything that is centred). Rows are staged
once as blocks of whole numbers; X is the matrix of rows less their mean. The bidiagonalisation alternates products X v, which
give the next left vector, and X'u, which give the next right vector. A left vector has one entry for each row, so it is never
stored: it is held as the combination w of columns with u = X w. One pass over the blocks takes the right vector v, already
freed of what earlier left vectors hold of X v, forms u = X w, its length, its products with all earlier left vectors (the
reorthogonalisation, repeated while any is not negligible) and X'u. What comes back from a pass is a sum of one number for each
dimension and step, added up by the executors. Right vectors are orthogonalised twice against all earlier ones on the driver.

Where the space is used up (equal eigenvalues, low rank) a fresh random direction starts again. The process stops when the
wanted singular values have converged and the variance that no found value explains is at most the least of them, so that none
can have been missed; else it takes as many steps as there are dimensions. The singular values s of the small bidiagonal
matrix give the eigenvalues s^2 / n, its right vectors the components.

State on the driver is three vectors for each step, whatever the number of rows; a lost executor costs its blocks of one pass.

Defined results: vectors that are null or hold a null, NaN or infinite entry take no part; shorter vectors are filled with
zeros; null ids and repeated rows count each; entries beyond 2**40 are held there; a deviation beyond 64 bits is held at the
largest such number (sums on the way are exact). Components of no variance (below 1e-10 of the largest deviation) do not exist,
so one row, equal rows and an empty table give an empty result. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stage, table

BLOCK_CELLS = 1 << 16
MOST = float(1 << 40)
RANK = 1e-10
BLOCKS = "ids array<long>, width int, data binary"


def blocks_of(vectors: DataFrame) -> DataFrame:
    """Staged blocks of whole-number rows of vectors (id, v)."""

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            b = b.filter(b.column(1).is_valid())
            v = b.column(1)
            lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(lengths)), lengths)
            whole = np.bincount(row[~np.isfinite(values)], minlength=len(lengths)) == 0
            ids, starts = b.column(0).to_pylist(), np.cumsum(lengths) - lengths
            width = int(lengths[whole].max(initial=0))
            take = np.flatnonzero(whole)
            step = max(1, BLOCK_CELLS // max(1, width))
            for lo in range(0, len(take), step):
                some = take[lo : lo + step]
                data = np.zeros((len(some), width), np.int64)
                for i, r in enumerate(some):
                    own = values[starts[r] : starts[r] + lengths[r]]
                    data[i, : len(own)] = np.clip(np.floor(64.0 * own), -MOST, MOST)
                yield pa.RecordBatch.from_arrays([pa.array([[ids[r] for r in some]], pa.list_(pa.int64())), pa.array([width], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["ids", "width", "data"])

    return stage(vectors.mapInArrow(build, BLOCKS), "whitening-rows")


def rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and whole-number rows of each block, filled to a width."""
    for ids, own, data in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
        ids = ids.as_py()
        x = np.frombuffer(data.as_buffer(), np.int64).reshape(len(ids), own)
        yield ids, np.pad(x, ((0, 0), (0, width - own))) if own < width else x


def summed(blocks: DataFrame, width: int, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over blocks of size numbers that ``of`` makes of one."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in it:
            for _, x in rows_of(b, width):
                total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["place", "value"])

    out = np.zeros(size)
    for place, value in blocks.mapInArrow(part, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out


def moments(blocks: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Number of rows, exact sums by dimension, and the exact sum of all squares."""
    from decimal import Decimal

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * width, 0
        for b in it:
            for ids, x in rows_of(b, width):
                n += len(ids)
                sums = [s + int(t) for s, t in zip(sums, x.sum(0))]
                most = int(np.abs(x).max(initial=0))
                squares += int((x * x).sum()) if most * most * x.size < 2**62 else sum(int(c) ** 2 for c in x.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(range(-2, width), pa.int64()), pa.array([Decimal(s) for s in (n, squares, *sums)], pa.decimal128(38, 0))], ["place", "value"])

    got = {r[0]: int(r[1]) for r in blocks.mapInArrow(part, "place long, value decimal(38,0)").groupBy("place").agg(F.sum("value")).collect()}
    return got.get(-2, 0), [got.get(i, 0) for i in range(width)], got.get(-1, 0)


def bidiagonalise(blocks: DataFrame, mean: np.ndarray, squares: float, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of the centred rows, falling, and their right vectors as columns; squares is the sum of all centred squares."""
    d, draw = len(mean), np.random.default_rng(seed)
    eps, size = np.finfo(float).eps, np.sqrt(squares)
    right, left, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # v, w with u = X w, and X'u, as columns
    alphas: list[float] = []
    betas: list[float] = []

    def free(r: np.ndarray) -> np.ndarray:
        for _ in range(2):
            r = r - right @ (right.T @ r)
        return r

    def fresh() -> np.ndarray:
        r = free(free(draw.standard_normal(d)))
        return r / np.linalg.norm(r)

    def products(w: np.ndarray, earlier: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|X w|^2, X'X w and the products of X w with earlier left vectors, in one pass."""

        def of(x: np.ndarray) -> np.ndarray:
            x = x - mean
            u = x @ w
            return np.concatenate([[u @ u], x.T @ u, (x @ earlier).T @ u])

        got = summed(blocks, d, 1 + d + earlier.shape[1], of)
        return max(got[0], 0.0), got[1 : 1 + d], got[1 + d :]

    v = fresh()
    while True:
        right = np.column_stack([right, v])
        w = v - left @ (back.T @ v)
        for _ in range(3):
            length, z, held = products(w, left)
            alpha = np.sqrt(length)
            if alpha <= d * eps * size or np.abs(held).max(initial=0) <= 4 * eps * size:
                break
            w = w - left @ held
        used_up = alpha <= d * eps * size
        alphas.append(0.0 if used_up else alpha)
        left, back = (np.column_stack([m, np.zeros(d) if used_up else x / alpha]) for m, x in ((left, w), (back, z)))
        steps = len(alphas)
        if steps == d:
            beta, v = 0.0, v
        else:
            r = free(back[:, -1] - alphas[-1] * v)
            beta = np.linalg.norm(r)
            beta, v = (beta, r / beta) if beta > d * eps * size else (0.0, fresh())
        rotated, values, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        wanted = min(k, steps)
        least = values[wanted - 1] ** 2 if steps >= k else 0.0
        certain = squares - (values**2).sum() <= max(least, 4 * d * eps * squares)
        if steps == d or certain and (beta * np.abs(rotated[-1, :wanted])).max() <= 2 * eps * size:
            return values[:wanted], right @ turned[:wanted].T
        betas.append(beta)


def whiten(vectors: DataFrame, k: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row of vectors (id, v) and each of the first k components."""
    blocks = blocks_of(vectors)
    d = blocks.agg(F.max("width")).first()[0] or 0
    n, sums, squares = moments(blocks, d)
    spread = n * squares - sum(s * s for s in sums)  # n times the sum of centred squares, exact
    values, components = np.zeros(0), np.zeros((d, 0))
    mean = np.array([s / n for s in sums]) if n else np.zeros(d)
    if spread:
        values, components = bidiagonalise(blocks, mean, spread / n, min(k, d))
        real = values > RANK * values[0]
        values, components = values[real], components[:, real]
        components = components * np.sign(components[np.abs(components).argmax(0), np.arange(len(values))])
    explained = values**2 / (spread / n) if spread else values
    scaled, m = components / (values / np.sqrt(n)) if spread else components, len(values)

    def of(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ scaled
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    error = 0.0
    if m:
        got = summed(blocks, d, m + m * m, of) / n
        error = float(np.abs(got[m:].reshape(m, m) - np.outer(got[:m], got[:m]) - np.eye(m)).max())

    def deviations(x: np.ndarray) -> np.ndarray:
        most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
        if most * most * max(1, d) < 2**62:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
        return np.array([min(sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)), 2**63 - 1) for r in x], np.int64)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, x in rows_of(b, d):
                total, y = len(ids) * m, (x - mean) @ scaled
                columns = [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), m))), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(ids)))]
                columns += [pa.array(np.full(total, n)), pa.array(np.repeat(deviations(x), m)), pa.array(y.ravel()), pa.array(np.tile(explained, len(ids))), pa.array(np.full(total, error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(rows, "id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitens all embeddings by their first 32 components."""
    return whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))).withColumnRenamed("id", "vec_id")
