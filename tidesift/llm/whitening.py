"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X never leave their tasks. A step multiplies X by one vector and Xᵀ by
the outcome, block by block, and the driver sees sums of the size of one vector.
Left vectors are as long as the table, so none is stored: each is X times a
vector the driver holds, and a task makes its part of all of them anew for the
reorthogonalisation. Right vectors are reorthogonalised by the driver. Both are
done in full, left ones again until nothing is left to take away. The singular
value decomposition of the small bidiagonal matrix gives components and
deviations.

Steps end when the leading components have converged and one more search from a
fresh direction, which finds directions of equal deviation, has not changed
them; the width of a vector is the most that is needed.

Entries become whole numbers (``SCALE`` and ``SHIFT``), so sums and squared
distances are exact, whatever the order of tasks. Rows are held as blocks of
``BLOCK`` rows in one written table, read again by every step.

Defined results
    null vector, null or non-finite entries    the row is left out
    entries of 2^52 or more                    the row is left out, as its whole numbers would not fit
    another length                             the length of most rows is the table's (of equal ones the
                                               greater); other rows, and empty vectors, are left out
    null id, equal ids, repeated rows          each row counts and is returned
    equal deviations                           any basis of their space, the same for all rows
    fewer components                           directions without deviation (1e-9 of the first one's) are none;
                                               equal rows have none, so no row is returned
    squared distance beyond a long             null
    empty table                                an empty result
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidesift.session import Workspace

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)
BLOCK = 4_096
COMPONENTS = 8
NO_DEVIATION = 1e-9
CONVERGED = 2.0**-50
FAN_IN = 64
MOST = 2**63 - 1


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8", copy=False)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([ids.cast(schema.field(0).type), pa.array([x.tobytes()], pa.binary())], schema=schema)


def _matrix(cell, width: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype="<i8").reshape(-1, width)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as whole numbers of any size."""
    if len(x) * float(np.abs(x).max(initial=0)) < 2.0**62:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(int(v) for v in column) for column in x.T]


class Centre:
    """Means of the whole numbers, held as whole part and remainder, so that centring rounds once."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.width = n, len(sums)
        self.base = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s - n * (s // n) for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.fraction

    def distances(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        away = x - self.base
        if (self.n * (float(np.abs(away).max(initial=0)) + 1)) ** 2 * max(self.width, 1) < 2.0**62:
            scaled = away * self.n - np.array(self.rest, dtype=np.int64)
            return np.einsum("ij,ij->i", scaled, scaled).tolist()
        rows = (sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in away)
        return [d if d <= MOST else None for d in rows]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for cell in batch.column(0):
            part = np.frombuffer(cell.as_buffer())
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def summed(blocks: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``kernel(rows)`` over all blocks; tasks add up their own, groups of tasks theirs, the driver the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column(0):
                part = kernel(_matrix(cell, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = blocks.select("x").mapInArrow(run, "sums binary")
    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = max(isqrt(tasks), -(-tasks // FAN_IN))
        parts = parts.repartition(tasks).mapInArrow(_merged, "sums binary")
    return np.sum([np.frombuffer(r["sums"]) for r in parts.collect()], axis=0)


def bidiagonalise(
    multiply: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, float, np.ndarray]], width: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of X, the leading ``wanted`` ones at least as far as there are any.

    ``multiply(W, w)`` makes U = X W and u = X w and returns Uᵀu, u·u and Xᵀu.
    """
    draw = np.random.default_rng(42)
    right = np.zeros((width, 0))  # V
    made = np.zeros((width, 0))  # W: the left vectors are U = X W
    back = np.zeros((width, 0))  # Xᵀ U
    small = np.zeros((0, 0))  # Uᵀ X V: the diagonal and the one above it, but for what a fresh direction brings

    def fresh() -> np.ndarray:
        v = draw.standard_normal(width)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v, top, settled, waiting = fresh(), 0.0, None, 0
    while True:
        above = back.T @ v
        w = v - made @ above
        for _ in range(4):
            overlap, square, image = multiply(made, w)
            w = w - made @ overlap
            above = above + overlap
            image = image - back @ overlap
            square = max(square - float(overlap @ overlap), 0.0)
            if float(overlap @ overlap) <= 1e-24 * square:
                break
        length = np.sqrt(square)
        right = np.column_stack([right, v])
        top = max(top, length, float(np.linalg.norm(above)))
        grown = np.zeros((small.shape[0] + (length > NO_DEVIATION * top / 10), right.shape[1]))
        grown[: small.shape[0], :-1] = small
        grown[: len(above), -1] = above
        more = 0.0
        if grown.shape[0] > small.shape[0]:
            grown[-1, -1] = length
            made, back = np.column_stack([made, w / length]), np.column_stack([back, image / length])
            rest = back[:, -1]
            for _ in range(2):
                rest = rest - right @ (right.T @ rest)
            more = float(np.linalg.norm(rest))
        small = grown
        left, values, turned = np.linalg.svd(small) if small.size else (np.zeros((0, 0)), np.zeros(0), np.eye(right.shape[1]))
        vectors = right @ turned[: len(values)].T
        if right.shape[1] == width:
            return values, vectors
        waiting -= 1
        done = more <= CONVERGED * top or (len(values) >= wanted and np.all(more * np.abs(left[-1, :wanted]) <= CONVERGED * top))
        if done and waiting <= 0:
            leading = np.pad(values[:wanted], (0, max(wanted - len(values), 0)))
            if settled is not None and np.allclose(leading, settled, rtol=1e-12, atol=NO_DEVIATION * top):
                return values, vectors
            settled, waiting = leading, 2 * wanted
            v = fresh()
        else:
            v = rest / more if more > CONVERGED * top else fresh()


class Whitening:
    """Means, components and deviations of a table of vectors; ``blocks`` are its rows."""

    def __init__(self, blocks: DataFrame, centre: Centre | None, values: np.ndarray, vectors: np.ndarray, id_type: T.DataType):
        self.blocks, self.centre, self.id_type = blocks, centre, id_type
        self.variances, self.components = values, vectors  # eigenvalues of the covariance, columns of unit length
        self.trace = self.identity_error = 0.0

    def _weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    def measure(self) -> None:
        """One pass: the covariance's trace, and how far the whitened rows' covariance is from the identity."""
        centre, weights = self.centre, self._weights()
        m = weights.shape[1]

        def kernel(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            z = rows @ weights
            return np.concatenate([[np.einsum("ij,ij->", rows, rows)], z.sum(axis=0), (z.T @ z).ravel()])

        found = summed(self.blocks, kernel, centre.width) / centre.n
        self.trace = float(found[0])
        means = found[1 : m + 1]
        covariance = found[m + 1 :].reshape(m, m) - np.outer(means, means)
        self.identity_error = float(np.abs(covariance - np.eye(m)).max(initial=0.0))

    def rows(self, id_column: str = "vec_id") -> DataFrame:
        """id, deviation (squared distance from the mean, times n squared) and whitened vector of every row."""
        schema = T.StructType().add(id_column, self.id_type).add("deviation", T.LongType()).add("whitened", T.ArrayType(T.DoubleType()))
        if not len(self.variances):
            return self.blocks.sparkSession.createDataFrame([], schema)
        centre, weights = self.centre, self._weights()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    x = _matrix(batch.column(1)[i], centre.width)
                    z = centre.centred(x) @ weights
                    offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1])
                    whitened = pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))
                    columns = [batch.column(0)[i].values, pa.array(centre.distances(x), pa.int64()), whitened]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_column, "deviation", "whitened"])

        return self.blocks.select("ids", "x").mapInArrow(run, schema)


def fit_whitening(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Means and leading components over all usable rows of a table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    space = Workspace(vectors.sparkSession, "whitening")
    entries = F.col(vector_column).cast("array<double>")
    usable = F.coalesce(F.forall(entries, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))), F.lit(False))
    rows = vectors.filter(usable & (F.size(entries) > 0))
    sizes = rows.groupBy(F.size(entries).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    id_type = vectors.schema[id_column].dataType
    schema = T.StructType().add("ids", T.ArrayType(id_type)).add("x", T.BinaryType())
    if first is None:
        return Whitening(vectors.sparkSession.createDataFrame([], schema), None, np.zeros(0), np.zeros((0, 0)), id_type)
    width = first["size"]
    whole = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    arrow = to_arrow_schema(schema)
    blocks = rows.filter(F.size(entries) == width).select(F.col(id_column).alias("id"), whole.alias("x"))
    blocks = space.keep(blocks.mapInArrow(lambda batches: _blocks(batches, arrow), schema))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            for cell in batch.column(0):
                x = _matrix(cell, width)
                n, sums = n + len(x), [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        columns = [pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in (n, *sums)])]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "total"])

    # sums as decimals, so that no number of rows is too many
    parts = blocks.select("x").mapInArrow(totals, "place int, total string")
    found = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {r["place"]: int(r["total"]) for r in found}
    centre = Centre(total[-1], [total[k] for k in range(width)])

    def multiply(made: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        def kernel(x: np.ndarray) -> np.ndarray:
            part = centre.centred(x)
            u = part @ w
            return np.concatenate([(part @ made).T @ u, [u @ u], part.T @ u])

        out = summed(blocks, kernel, width)
        k = made.shape[1]
        return out[:k], float(out[k]), out[k + 1 :]

    values, columns = bidiagonalise(multiply, width, components)
    real = min(int((values > NO_DEVIATION * values.max(initial=0.0)).sum()), components) if len(values) else 0
    columns = columns[:, :real]
    if real:
        heads = columns[np.abs(columns).argmax(axis=0), np.arange(real)]
        columns = columns * np.where(heads < 0, -1.0, 1.0)
    model = Whitening(blocks, centre, values[:real] ** 2 / centre.n, columns, id_type)
    if real:
        model.measure()
    return model
