"""Whitening of embeddings: leading eigenpairs of their covariance by block Jacobi-Davidson, never forming it.

Only two things depend on the number of rows: the staged list of distinct vectors, kept as blocks of whole numbers,
and the centred product V q = sum((x - mean) ((x - mean) . q)) / n, one Spark job that streams the blocks against a few
vectors q at a time. A task returns one sum of the size of q; the number of tasks is that of the cluster's cores.
Everything between two products has the size of a few vectors and happens on the driver: Rayleigh-Ritz in the search
space, residuals, and the steps of MINRES on the projected correction equations. Pairs whose residual has reached
double precision are locked; the search goes on orthogonally to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stage

COMPONENTS = 4
#: Entries become whole numbers of 1/SCALE.
SCALE = 256
#: Vectors in the search beside the wanted ones; size at which the search space is cut back to its best half.
GUARD, MAX_BASIS = 4, 40
#: Steps of MINRES in one correction, corrections before giving up.
INNER_STEPS, OUTER_STEPS = 10, 200
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    """Mean and unit eigenvectors (columns) of the covariance over ``n`` distinct vectors, by falling eigenvalue."""

    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    products: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id`` and ``x`` (floor of scale times each entry) of the rows whose vector is there and all finite."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    whole: Column = F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    return embeddings.where(finite).select(F.col(f"`{id_col}`").alias("id"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(vectors: DataFrame, width: int) -> DataFrame:
    """Vectors as blocks of rows in the narrowest whole type that holds them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("x"), width)
            if rows.size:
                low, high = int(rows.min()), int(rows.max())
                kind = next(t for t in ("int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
                yield pa.RecordBatch.from_pydict({"kind": [kind], "rows": pa.array([rows.astype(kind).tobytes()], pa.binary())})

    return vectors.mapInArrow(pack, "kind string, rows binary")


def _fold(blocks: DataFrame, width: int, add: Callable[[object, np.ndarray], object], start: object, text: Callable[[object], bytes]) -> list[bytes]:
    """One result per task, folded over the blocks of the task in their order; results come in the order of tasks."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start
        for batch in batches:
            for kind, rows in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                total = add(total, np.frombuffer(rows, kind).reshape(-1, width))
        yield pa.RecordBatch.from_pydict({"part": pa.array([text(total)], pa.binary())})

    tasks = blocks.sparkSession.sparkContext.defaultParallelism
    return [bytes(row.part) for row in blocks.coalesce(tasks).mapInArrow(fold, "part binary").collect()]


def _summed(blocks: DataFrame, width: int, shape: tuple[int, ...], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of a kernel's arrays over all blocks."""
    parts = _fold(blocks, width, lambda total, rows: total + kernel(rows), np.zeros(shape), lambda total: total.tobytes())
    return np.sum([np.frombuffer(part).reshape(shape) for part in parts], axis=0) if parts else np.zeros(shape)


def _exact_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and sums by dimension, as exact whole numbers."""
    def add(total, rows):
        small = np.abs(rows.astype(float)).max() * len(rows) < 2.0**62
        sums = rows.sum(axis=0, dtype=np.int64 if small else object)
        return [total[0] + len(rows), *[a + int(b) for a, b in zip(total[1:], sums, strict=True)]]

    parts = _fold(blocks, width, add, [0] * (width + 1), lambda total: " ".join(map(str, total)).encode())
    total = [sum(column) for column in zip(*[map(int, part.split()) for part in parts], strict=True)]
    return total[0], total[1:]


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to ``against`` and to each other, twice; those that vanish are left out."""
    kept: list[np.ndarray] = []
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            column = column - against @ (against.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e3 * EPS * size:
            kept.append(column / left)
    return np.array(kept).T if kept else np.zeros((new.shape[0], 0))


def minres(product: Product, right: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Several symmetric systems at once, one per column, each with its own MINRES recurrence; one product per step.

    Stops when every residual has fallen by ``reduction``, or after ``steps``.
    """
    norm = np.linalg.norm(right, axis=0)
    beta, eta = np.zeros_like(norm), norm.copy()
    v_old, v = np.zeros_like(right), right / np.where(norm > 0, norm, 1)
    w_old, w, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c_old, c, s_old, s = np.ones_like(norm), np.ones_like(norm), np.zeros_like(norm), np.zeros_like(norm)
    for _ in range(steps):
        open_ = np.abs(eta) > reduction * norm
        if not open_.any():
            break
        image = product(v)
        alpha = (v * image).sum(axis=0)
        v_new = image - alpha * v - beta * v_old
        beta_new = np.linalg.norm(v_new, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        safe = np.where(rho > 0, rho, 1)
        w_new = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe
        c_new, s_new = delta / safe, beta_new / safe
        x = x + np.where(open_ & (rho > 0), c_new * eta, 0) * w_new
        eta = np.where(rho > 0, -s_new * eta, 0)
        v_old, v = v, v_new / np.where(beta_new > 0, beta_new, 1)
        w_old, w, beta, c_old, c, s_old, s = w, w_new, beta_new, c, c_new, s, s_new
    return x


def jacobi_davidson(product: Product, width: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling) and unit eigenvectors of the symmetric operator behind ``product``.

    A pair is locked when its residual is at most 16 sqrt(width) roundings of the largest eigenvalue.
    """
    wanted = min(wanted, width)
    block = min(width, wanted + GUARD)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((width, block)), np.zeros((width, 0)))
    images = product(basis)
    locked = np.zeros((width, 0))
    locked_images = np.zeros((width, 0))
    top = 0.0
    for step in range(OUTER_STEPS):
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        top = max(top, float(np.abs(values).max()))
        residuals = images - basis * values
        residuals = residuals - locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        limit = 16 * np.sqrt(width) * EPS * top
        done = 0
        while locked.shape[1] + done < wanted and done < basis.shape[1] and sizes[done] <= limit:
            done += 1
        locked, locked_images = np.hstack([locked, basis[:, :done]]), np.hstack([locked_images, images[:, :done]])
        basis, images, values, residuals = basis[:, done:], images[:, done:], values[done:], residuals[:, done:]
        if locked.shape[1] >= wanted:
            break
        if basis.shape[1] + block > MAX_BASIS:
            half = max(block, MAX_BASIS // 2)
            basis, images, values, residuals = basis[:, :half], images[:, :half], values[:half], residuals[:, :half]
        lead = min(wanted - locked.shape[1] + 1, basis.shape[1])
        held = np.hstack([locked, basis[:, :lead]])

        def aside(columns: np.ndarray, held: np.ndarray = held) -> np.ndarray:
            return columns - held @ (held.T @ columns)

        def shifted(columns: np.ndarray, shift: np.ndarray = values[:lead]) -> np.ndarray:
            columns = aside(columns)
            return aside(product(columns) - columns * shift)

        corrections = minres(shifted, aside(-residuals[:, :lead]), INNER_STEPS, 2.0 ** -min(step + 2, 10))
        new = _orthonormal(corrections, np.hstack([locked, basis]))
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + step + 1).standard_normal((width, 1)), np.hstack([locked, basis]))
        basis, images = np.hstack([basis, new]), np.hstack([images, product(new)])
    else:
        raise ArithmeticError("the eigenvectors did not converge")
    # The locked pairs in order: once more Rayleigh-Ritz in their span.
    inner = locked.T @ locked_images
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    vectors = locked @ turn[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[::-1], vectors / np.linalg.norm(vectors, axis=0) * np.where(signs == 0, 1, signs)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct ``x`` of ``whole_vectors``; None where there are none.

    The commonest length counts (of equally common ones the longest). Components whose eigenvalue is no more than
    rounding of the largest are left out: equal vectors have none, fewer than five distinct ones have fewer than four.
    """
    sizes = vectors.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not sizes or sizes[0].width < 1:
        return None
    width = sizes[0].width
    blocks = stage(_blocks(vectors.where(F.size("x") == width).select("x").distinct(), width), "fit-list")
    n, sums = _exact_sums(blocks, width)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, width, (1,), lambda rows: np.array([np.square(rows - mean).sum()]))[0]) / n
    products = 0

    def product(columns: np.ndarray) -> np.ndarray:
        nonlocal products
        products += 1

        def kernel(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ columns)

        return _summed(blocks, width, columns.shape, kernel) / n

    values, basis = jacobi_davidson(product, width, components) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    sound = values > width * EPS * (values[0] if len(values) else 0.0)
    values, basis = values[sound], basis[:, sound]
    k = len(values)
    to_white = basis / np.sqrt(values)
    middle = _summed(blocks, width, (k,), lambda rows: ((rows - mean) @ to_white).sum(axis=0)) / n

    def second_moments(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ to_white - middle
        return white.T @ white

    error = np.abs(_summed(blocks, width, (k, k), second_moments) / n - np.eye(k))
    return Whitening(width, n, sums, basis, values, trace, float(error.max()) if k else 0.0, products)


def _deviation(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 per row, exact; None where 64 bits cannot hold it.

    Arithmetic on 64 bits is exact up to multiples of 2^64, and the floating-point sum tells whether there are any.
    """
    wrap = (1 << 64) - 1
    off = rows.astype(np.uint64) * np.uint64(n & wrap) - np.array([s & wrap for s in sums], dtype=np.uint64)
    exact = (off * off).sum(axis=1, dtype=np.uint64)
    about = np.square(rows.astype(float) * float(n) - np.array([float(s) for s in sums])).sum(axis=1)
    clear, border = about < 2.0**62, (about >= 2.0**62) & (about < 2.0**64)
    out = [int(value) if ok else None for value, ok in zip(exact, clear, strict=True)]
    for i in np.flatnonzero(border):
        total = sum((n * int(x) - s) ** 2 for x, s in zip(rows[i], sums, strict=True))
        out[i] = total if total < 2**63 else None
    return out


def apply(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kind = dict(vectors.dtypes)["id"]
    mean, projection, k = model.mean, model.projection, len(model.values)
    explained = model.values / model.trace if k else model.values
    n, sums, width, error = model.n, model.sums, model.width, model.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            if not count or not k:
                continue
            rows = _matrix(batch.column("x"), width)
            again = np.repeat(np.arange(count), k)
            deviation = pa.array(_deviation(rows, n, sums), pa.int64())
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("id").take(pa.array(again)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                "n": pa.array(np.full(count * k, n, dtype=np.int64)),
                "deviation": deviation.take(pa.array(again)),
                "whitened": pa.array(((rows - mean) @ projection).ravel()),
                "explained": pa.array(np.tile(explained, count)),
                "identity_error": pa.array(np.full(count * k, error)),
            })

    same = vectors.where(F.size("x") == width)
    return same.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
                                    "explained double, identity_error double")


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """Every vector projected on the leading components of the distinct vectors, scaled to unit variance.

    * rows whose vector is null or holds a null, NaN or infinite entry go; so do vectors of another length than the
      commonest; entries whose ``scale``-fold passes 64 bits count as the nearest long
    * rows that repeat an id or a vector come out each; a vector counts once in the fit; a null id stays null
    * no rows, only empty vectors, or all vectors equal: an empty result; where the vectors span fewer dimensions than
      ``components``, only that many come out
    * ``deviation`` is null where it passes 64 bits; equal eigenvalues leave the choice of their vectors open
    * other columns, whatever their names, are not read
    """
    vectors = whole_vectors(embeddings, id_col, vector_col, scale)
    model = fit(vectors, components)
    if model is None:
        model = Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    return apply(vectors, model)
