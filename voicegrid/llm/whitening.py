"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Components are put on a grid, x = floor(scale * c), so that copies are equal numbers; the model is fitted on every different x
once. Each task sums its own rows into one scatter matrix, centred by the exact mean before it multiplies. Matrices are added in
groups of `GROUP`, level by level, until the driver adds the last few: bounded by the vectors' width, not by their number.

The scatter is factored as V = P L L' P', pivoting on the largest remaining diagonal, until what remains is below
rounding. Rotating pairs of columns of L until all are orthogonal gives L W = U S: the columns' squared lengths
are the eigenvalues of V and the normalised columns its eigenvectors. Small eigenvalues keep their relative precision, as V
is never rotated from both sides.

Edge cases. Rows take no part if their vector is null, empty, of another length than most vectors' (of equally frequent
lengths the smallest), or holds null or non-finite entries. Entries whose grid value passes 62 bits are held at that bound. Rows without id stay. Repeated rows stay, and
count once in the fit. Directions without variance are no components, so there may be fewer than asked for, and none if
all vectors are equal. A deviation past 64 bits is null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegrid.session import materialize

SCALE = 256
COMPONENTS = 4
# So many partial matrices at most are added by one task, and by the driver in the end.
GROUP = 16
LARGEST = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """A fitted model: the number of different vectors, their exact sums, and components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # one row per component
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        # Python divides integers of any size to the nearest double.
        return np.array([s / self.n for s in self.sums])


def on_grid(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x as array<bigint>) of the rows that take part."""
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).first()
    held = F.transform("vector", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-LARGEST)), F.lit(LARGEST))).cast("bigint"))
    return rows.filter(F.size("vector") == (size["size"] if size else 0)).select("vec_id", held.alias("x"))


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of 64-bit integers, of any size."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(l) for h, l in zip(high, low)]


def totals(fit: DataFrame, width: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and exact sums per dimension."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, [0] * width
        for part in parts:
            count += part.num_rows
            sums = [a + b for a, b in zip(sums, exact_sums(_matrix(part.column(0), width)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(width), -1], pa.int32()), pa.array([str(s) for s in [*sums, count]])], names=["i", "s"]
        )

    parts = fit.select("x").mapInArrow(batches, "i int, s string")
    found = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(width))


def scatter(rows: DataFrame, width: int, points: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all rows of p p', where `points` gives a batch's rows p, centred already."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((width, width))
        for part in parts:
            p = points(part)
            whole += p.T @ p
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int32()), pa.array([whole.astype("<f8").tobytes()], pa.binary())], names=["task", "part"]
        )

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [frame["task"].iloc[0] // GROUP], "part": [_total(zip(frame["task"], frame["part"]), width).tobytes()]})

    partial = materialize(rows.mapInArrow(batches, "task int, part binary"), "scatter")
    while partial.count() > GROUP:
        grouped = partial.groupBy(F.floor(F.col("task") / GROUP)).applyInPandas(added, "task int, part binary")
        partial = materialize(grouped, "scatter")
    return _total(partial.collect(), width).reshape(width, width)


def _total(parts: Iterable[tuple[int, bytes]], width: int) -> np.ndarray:
    """Sum of stored matrices, in the order of their numbers."""
    whole = np.zeros(width * width)
    for _, part in sorted(parts, key=lambda p: p[0]):
        whole += np.frombuffer(part, "<f8")
    return whole


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with matrix[order][:, order] = L L'; L has as many columns as the matrix has rank."""
    rest, width = matrix.astype(float).copy(), len(matrix)
    order, lower = np.arange(width), np.zeros((width, width))
    floor = width * np.finfo(float).eps * rest.diagonal().max(initial=0.0)
    for k in range(width):
        pivot = k + int(rest.diagonal()[k:].argmax())
        if rest[pivot, pivot] <= floor:
            return order, lower[:, :k]
        if pivot != k:
            swap = [pivot, k]
            rest[[k, pivot]] = rest[swap]
            rest[:, [k, pivot]] = rest[:, swap]
            lower[[k, pivot]] = lower[swap]
            order[[k, pivot]] = order[swap]
        lower[k, k] = np.sqrt(rest[k, k])
        lower[k + 1:, k] = rest[k + 1:, k] / lower[k, k]
        rest[k + 1:, k + 1:] -= np.outer(lower[k + 1:, k], lower[k + 1:, k])
    return order, lower


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` with its columns rotated in pairs until all are orthogonal.

    Each round turns disjoint pairs together; as many rounds as there are other columns meet every pair once.
    """
    columns = factor.T.copy()
    count = len(columns)
    if count < 2:
        return columns.T
    seats = np.arange(count + count % 2)  # an odd one out sits against nobody
    close = len(factor) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            left, right = seats[: len(seats) // 2], seats[len(seats) // 2:][::-1]
            both = (left < count) & (right < count)
            i, j = left[both], right[both]
            a, b = columns[i], columns[j]
            aa, bb, ab = (np.einsum("rc,rc->r", x, y) for x, y in ((a, a), (b, b), (a, b)))
            apart = np.abs(ab) > close * np.sqrt(aa * bb)
            if apart.any():
                turned = True
                i, j, a, b, aa, bb, ab = i[apart], j[apart], a[apart], b[apart], aa[apart], bb[apart], ab[apart]
                z = (bb - aa) / (2 * ab)
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                columns[i], columns[j] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            return columns.T
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def components(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as rows) of a positive semi-definite matrix, by falling eigenvalue."""
    order, lower = pivoted_cholesky(matrix)
    turned = one_sided_jacobi(lower)
    lengths = np.linalg.norm(turned, axis=0)
    ranked = np.argsort(-lengths, kind="stable")
    directions = np.zeros((len(ranked), len(matrix)))
    directions[:, order] = (turned[:, ranked] / lengths[ranked]).T
    return lengths[ranked] ** 2, directions


def fit(grid: DataFrame) -> tuple[Whitening | None, DataFrame]:
    """The model of the different vectors of `grid`, and these as a stored table (x); None if there is no vector."""
    different = materialize(grid.select("x").distinct(), "whitening-fit")
    first = different.select(F.size("x").alias("width")).limit(1).first()
    if first is None:
        return None, different
    n, sums = totals(different, width := first["width"])
    mean = Whitening(n, sums, np.zeros((0, width)), np.zeros(0), 0.0).mean
    matrix = scatter(different, width, lambda part: _matrix(part.column(0), width, np.float64) - mean) / n
    values, directions = components(matrix)
    return Whitening(n, sums, directions, values, float(np.trace(matrix))), different


def _projection(model: Whitening, count: int) -> Callable[[np.ndarray], np.ndarray]:
    mean, turned = model.mean, (model.directions[:count] / np.sqrt(model.values[:count])[:, None]).T
    return lambda x: (x.astype(np.float64) - mean) @ turned


def identity_error(model: Whitening, different: DataFrame, count: int = COMPONENTS) -> float:
    """Largest absolute entry of (covariance of the whitened fit vectors - identity)."""
    width, count = len(model.sums), min(count, len(model.values))
    if not count:
        return 0.0
    project = _projection(model, count)

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(count)
        for part in parts:
            whole += project(_matrix(part.column(0), width)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(whole)], names=["i", "s"])

    found = dict(different.mapInArrow(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect())
    mean = np.array([found[i] for i in range(count)]) / model.n
    covariance = scatter(different, count, lambda part: project(_matrix(part.column(0), width)) - mean) / model.n
    return float(np.abs(covariance - np.eye(count)).max())


def exact_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 for every row."""
    bits = (n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))).bit_length()
    spare = len(sums).bit_length()
    if 2 * bits + spare <= 63:
        off = n * x - np.array(sums, dtype=np.int64)
        return np.einsum("rc,rc->r", off, off).tolist()
    if bits <= 52 and spare <= 11:
        # Two digits to the base 2^26, whose products add up inside 64 bits.
        off = n * x - np.array(sums, dtype=np.int64)
        high, low = off >> 26, off & ((1 << 26) - 1)
        parts = (np.einsum("rc,rc->r", a, b).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [(hh << 52) + (hl << 27) + ll for hh, hl, ll in zip(*parts)]
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]


def whiten(grid: DataFrame, model: Whitening, count: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened): every row's exact deviation and its coordinates on the first components."""
    width, project = len(model.sums), _projection(model, min(count, len(model.values)))
    n, sums, kind = model.n, model.sums, grid.schema["vec_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(1), width)
            deviations = [d if d < 1 << 63 else None for d in exact_deviations(x, n, sums)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(deviations, pa.int64()), pa.array(list(project(x)), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    return grid.select("vec_id", "x").mapInArrow(batches, f"vec_id {kind}, deviation bigint, whitened array<double>")


def whitened_rows(
    table: DataFrame, count: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row and component up to `count`."""
    grid = on_grid(table, id_column, vector, scale)
    model, different = fit(grid)
    if model is None:
        model = Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
        placed, error = grid.selectExpr("vec_id", "0L AS deviation", "array(0D) AS whitened").limit(0), 0.0
    else:
        placed, error = whiten(grid, model, count), identity_error(model, different, count)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:count]]).cast("array<double>")
    return placed.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
