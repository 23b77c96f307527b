"""Whitening of whole-number vectors by shifted CholeskyQR.

`fit` reads the vectors a few times. The first pass sums each dimension exactly. Every further one
centres the rows, solves them against the triangular factors found so far and adds up their Gram
matrix; tasks add up their own rows, and the partial sums are added in a tree of shuffles, so that
the driver meets one matrix of dimension x dimension, whatever the number of rows. The first
factor is taken from the Gram matrix plus a small multiple of the identity, which keeps the
factorisation alive on ill-conditioned data; the passes after it mend what the shift bent, until
the rows are orthonormal. The product of the factors is R of the centred table, and its singular
values and right singular vectors are the scales and directions of the whitening.

Rows whose vector is null or holds a null take no part, nor do rows whose length is not the table's most
common one (the greater, if two are equally common). Repeated rows and null or repeated ids count as rows.
Directions without spread (below 1e-10 of the widest, such as constant dimensions) are no components,
so one row or only equal rows give none; an empty table gives no rows. Entries must lie within 2**46.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest entry; Gram passes; the spread of a direction, against the widest, that counts as none.
LARGEST, PASSES, NO_SPREAD = 1 << 46, 6, 1e-10
#: Columns solved together, and partial sums on each level of the tree.
BLOCK, LEVELS = 32, (64, 8, 1)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening. The mean of a dimension is low + rest / n, in whole numbers."""

    n: int
    low: np.ndarray
    rest: list[int]
    directions: np.ndarray  # dimension x components, unit columns
    scales: np.ndarray  # standard deviation along each
    explained: np.ndarray  # share of the trace of the covariance
    identity_error: float  # largest absolute entry of the whitened covariance minus the identity


def whole_numbers(vector: Column, scale: float = 64, shift: int = 0) -> Column:
    """floor(scale * entry) + shift of each entry as double; null if the vector or an entry is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale) + F.lit(shift).cast("long")))


def _matrix(vectors: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their entries."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = vectors.flatten()
    fits = lengths == dimension
    if values.null_count:
        owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
        fits[owner[values.is_null().to_numpy(zero_copy_only=False)]] = False
        values = values.fill_null(0)
    flat = values.to_numpy(zero_copy_only=False)
    if not fits.all():
        flat = flat[np.repeat(fits, np.maximum(lengths, 0))]
    return fits, flat.reshape(-1, dimension)


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper), by forward substitution over blocks of columns."""
    out = np.array(rows, dtype=np.float64)
    for at in range(0, len(upper), BLOCK):
        end = min(at + BLOCK, len(upper))
        if at:
            out[:, at:end] -= out[:, :at] @ upper[:at, at:end]
        for j in range(at, end):
            out[:, j] = (out[:, j] - out[:, at:j] @ upper[at:j, j]) / upper[j, j]
    return out


def _moments(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Dimension, rows and exact sums of the most common length."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for d in map(int, np.unique(lengths[lengths > 0])):
                _, x = _matrix(batch.column(0), d)
                if len(x) and max(-int(x.min()), int(x.max())) >= LARGEST:
                    raise ValueError("entries must lie within 2**46")
                for at in range(0, len(x), 1 << 16):
                    sums[d] = sums.get(d, 0) + x[at : at + (1 << 16)].sum(axis=0).astype(object)
                rows[d] = rows.get(d, 0) + len(x)
        for d, total in sums.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [rows[d]] * d, "s": [str(v) for v in total]})

    each = vectors.mapInArrow(partial, "d long, i long, n long, s string")
    each = each.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    each = each.groupBy("d").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    top = each.where("n > 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return (int(top[0].d), int(top[0].n), [int(x.s) for x in top[0].s]) if top else (0, 0, [])


def _centred(x: np.ndarray, low: np.ndarray, rest: list[int], n: int) -> np.ndarray:
    return (x - low).astype(np.float64) - np.array([r / n for r in rest])


def _gram(vectors: DataFrame, low: np.ndarray, rest: list[int], n: int, factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """Gram matrix of the centred rows, solved against `factors` and multiplied by `last`."""
    dimension = len(low)
    size = dimension if last is None else last.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = _centred(_matrix(batch.column(0), dimension)[1], low, rest, n)
            for upper in factors:
                rows = solved(rows, upper)
            if last is not None:
                rows = rows @ last
            total += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "gram": [total.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            for gram in batch.column("gram"):
                total += np.frombuffer(gram.as_py()).reshape(size, size)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "gram": [total.tobytes()]})

    sums = vectors.mapInArrow(partial, "task long, gram binary")
    for parts in LEVELS:
        sums = sums.repartition(parts, "task").mapInArrow(added, "task long, gram binary")
    total = sum((np.frombuffer(r.gram).reshape(size, size) for r in sums.select("gram").collect()), np.zeros((size, size)))
    return (total + total.T) / 2


def fit(df: DataFrame, vector_col: str = "vector", components: int = 32) -> Whitening:
    """The whitening of `vector_col` (array of bigint): at most `components` directions, the widest first."""
    vectors = df.select(F.col(vector_col).alias("vector")).where(F.col("vector").isNotNull())
    dimension, n, sums = _moments(vectors)
    low, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    none = Whitening(n, low, rest, np.zeros((dimension, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not n:
        return none
    factors: list[np.ndarray] = []
    spread = 0.0
    for k in range(PASSES):
        gram = _gram(vectors, low, rest, n, factors)
        if not k:
            spread = float(np.trace(gram))
            if not spread:
                return none
        orthonormal = k > 0 and np.abs(gram - np.eye(dimension)).max() < 1e-6
        shift = 11 * (n * dimension + dimension * (dimension + 1)) * np.finfo(np.float64).eps / 2 * np.linalg.norm(gram, 2)
        alive = k > 0 and np.linalg.eigvalsh(gram)[0] > 4 * shift
        factors.append(np.linalg.cholesky(gram if orthonormal or alive else gram + shift * np.eye(dimension)).T)
        if orthonormal:
            break
    r = factors[0]
    for upper in factors[1:]:
        r = upper @ r
    _, widths, directions = np.linalg.svd(r)
    keep = min(components, int((widths > NO_SPREAD * widths[0]).sum()))
    directions = directions[:keep].T
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    scales = widths[:keep] / np.sqrt(n)
    error = np.abs(_gram(vectors, low, rest, n, [], directions / scales) / n - np.eye(keep)).max(initial=0.0)
    return Whitening(n, low, rest, directions, scales, scales**2 / (spread / n), float(error))


def transform(df: DataFrame, model: Whitening, vector_col: str = "vector") -> DataFrame:
    """The rows that take part, with deviation (decimal, exact sum of (n*x - S)**2) and whitened (array of double)."""
    n, low, rest = model.n, model.low, model.rest
    if not n:
        return df.where(F.lit(False)).withColumns({"deviation": F.lit(None).cast("decimal(38,0)"), "whitened": F.lit(None).cast("array<double>")})
    onto = model.directions / model.scales if len(model.scales) else model.directions

    def exact(x: np.ndarray) -> list[int]:
        """With x - low = c: n*n*sum(c*c) - 2*n*sum(c*rest) + sum(rest*rest)."""
        c = x - low
        bound = max(int(np.abs(c).max(initial=0)), 1)
        c = c if bound * max(bound, *rest, 1) * max(1, len(low)) < 1 << 62 else c.astype(object)
        squares, mixed = (c * c).sum(axis=1).tolist(), (c * np.array(rest, dtype=c.dtype)).sum(axis=1).tolist()
        last = sum(r * r for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]

    @F.arrow_udf("struct<deviation: decimal(38,0), whitened: array<double>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            _, x = _matrix(vectors, len(low))
            whitened = (_centred(x, low, rest, n) @ onto).tolist()
            columns = [pa.array(exact(x), pa.decimal128(38, 0)), pa.array(whitened, pa.list_(pa.float64()))]
            yield pa.StructArray.from_arrays(columns, ["deviation", "whitened"])

    out, vector = f"__whitened_{len(df.columns)}", F.col(vector_col)
    part = df.where((F.size(vector) == len(low)) & F.forall(vector, lambda x: x.isNotNull()))
    told = part.withColumn(out, made(vector)).drop("deviation", "whitened")
    return told.withColumns({"deviation": F.col(out)["deviation"], "whitened": F.col(out)["whitened"]}).drop(out)
