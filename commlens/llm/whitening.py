"""Embedding whitening with distributed block matrices.

A vector's entries, as double, are put on a grid: x = floor(64 * entry) + 1000000. The fit list holds each distinct x vector once.
Its size n and sums S are exact whole numbers. The rows x - S / n are indexed: those of the fit list first, repeated vectors
after them. As an MLlib BlockMatrix, the fit rows multiplied by their own transpose give the scatter matrix; the middle dimension is split, so
the product is summed over many tasks and only one dim * dim matrix reaches the driver. Its eigenvectors over the roots of their
eigenvalues form the whitening matrix, one block, and the BlockMatrix of all rows multiplied by it projects every row. The same
product on the projected fit rows measures how far their covariance is from the identity.

Two things reach the driver: dim * dim numbers, and MLlib's list of block coordinates (one pair for BLOCK_CELLS / dim rows).

Left out: rows whose vector is null, empty, or holds null or non-finite entries. Vectors of different lengths and entries beyond the
grid's 52 bits raise a ValueError. Components whose eigenvalue is zero to double precision (at most 2.2e-16 * dim of the
largest) cannot be whitened and give no rows; so fewer than two distinct vectors, or an empty table, give an empty result. Repeated rows are
rows of their own; vec_id may be null or repeated and is carried as it is. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Numbers in a block of the matrices (4 MB), and blocks that one task multiplies.
BLOCK_CELLS, BLOCKS_A_TASK = 1 << 19, 16
LIMIT = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors, their sums, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> list[float]:
        return _mean(self.n, self.sums)

    @property
    def whitening(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _mean(n: int, sums: list[int]) -> list[float]:
    return [s // n + (s % n) / n for s in sums]


def grid(embeddings: DataFrame, column: str) -> DataFrame:
    """part, row, vec_id, x of the rows that remain."""
    id_type = embeddings.schema["vec_id"].dataType.simpleString()

    def snap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = sizes > 0
            good[owner[~np.isfinite(flat)]] = False
            flat = flat[good[owner]]
            scaled = np.floor(flat * SCALE)
            if (np.abs(scaled) >= LIMIT).any():
                raise ValueError("an entry is too large for the grid")
            kept = np.flatnonzero(good)
            ends = np.concatenate([[0], np.cumsum(sizes[kept])]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(ends), pa.array(scaled.astype(np.int64) + SHIFT))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(kept), part, np.int32)),
                    pa.array(np.arange(rows, rows + len(kept))),
                    batch.column(0).take(pa.array(kept)),
                    x,
                ],
                names=["part", "row", "vec_id", "x"],
            )
            rows += len(kept)

    vectors = embeddings.select("vec_id", F.col(column).alias("embedding"))
    return stored(vectors.mapInArrow(snap, f"part int, row long, vec_id {id_type}, x array<bigint>"), "grid")


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `index`: 0 to n - 1 for the first row of every distinct x, then the repeated ones; and n."""
    place = F.struct("part", "row")
    # one x may be a third of all rows: grouped, not joined, and its row is found by part and row
    firsts = rows.groupBy("x").agg(F.min(place).alias("first")).select("first.part", "first.row", F.lit(True).alias("is_first"))
    marked = rows.join(firsts, ["part", "row"], "left").select(
        F.when(F.col("is_first"), 0).otherwise(1).alias("repeated"), "part", "row", "vec_id", "x"
    )
    marked = stored(marked, "marked")
    # one row for each task that read the table, twice
    totals = marked.groupBy("repeated", "part").agg(F.count(F.lit(1)).alias("count"))
    before = Window.orderBy("repeated", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("repeated", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    n = marked.where("repeated = 0").count()
    within = Window.partitionBy("repeated", "part").orderBy("row")
    numbered = marked.withColumn("place", F.row_number().over(within) - 1)
    return (
        stored(
            numbered.join(F.broadcast(offsets), ["repeated", "part"]).select(
                (F.col("base") + F.col("place")).alias("index"), "vec_id", "x"
            ),
            "indexed",
        ),
        n,
    )


def column_sums(fit_rows: DataFrame) -> list[int]:
    """The sum of each dimension, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = x.value_lengths().to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            if sizes.min() != sizes.max():
                raise ValueError("vectors of different lengths")
            sums = x.flatten().to_numpy().reshape(len(sizes), -1).sum(axis=0)
            totals[len(sums)] = totals.get(len(sums), 0) + sums
        if len(totals) > 1:
            raise ValueError("vectors of different lengths")
        for sums in totals.values():
            yield pa.RecordBatch.from_arrays([pa.array([sums])], names=["sums"])

    parts = fit_rows.select("x").mapInArrow(add, "sums array<bigint>")
    rows = parts.select(F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("parts")
    )
    found = sorted(rows.collect())
    if len({r["parts"] for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return [int(r["s"]) for r in found]


def _centred(mean: list[float]) -> Column:
    return F.zip_with("x", F.lit(mean), lambda x, m: x.cast("double") - m)


def _matrix(rows: DataFrame, values: Column, count: int, dim: int) -> BlockMatrix:
    vectors = rows.select("index", array_to_vector(values).alias("vector"))
    rows_a_block = max(1, BLOCK_CELLS // dim)
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, dim).toBlockMatrix(rows_a_block, dim)


def _scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix; the rows are split over many tasks, whose dim * dim products are added up."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    transposed = matrix.transpose()
    product = transposed._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def fit(rows: DataFrame, n: int, components: int = COMPONENTS) -> Fit | None:
    """The covariance of the fit list (divisor n) and its largest components; None where there is none."""
    fit_rows = rows.where(F.col("index") < n)
    sums = column_sums(fit_rows)
    if not sums:
        return None
    mean = _mean(n, sums)
    covariance = _scatter(_matrix(fit_rows, _centred(mean), n, len(sums))) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    usable = min(components, int((values > max(values[0], 0.0) * np.finfo(float).eps * len(sums)).sum()))
    values, vectors = values[:usable], vectors[:, :usable]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(usable)])
    return Fit(n, sums, values, vectors, trace) if usable else None


def deviation(found: Fit) -> Column:
    """Sum over dimensions of (n * x - S)^2, in 38 digits; beyond a long the cast to it fails and nothing wraps around."""
    wide = F.lit([str(s - found.n * SHIFT) for s in found.sums]).cast("array<decimal(28,0)>")
    near = F.zip_with(
        F.col("x"),
        wide,
        lambda x, s: (x - F.lit(SHIFT)).cast("decimal(18,0)") * F.lit(found.n).cast("decimal(12,0)") - s,
    )
    total = F.aggregate(
        near,
        F.lit(0).cast("decimal(38,0)"),
        lambda a, d: (a + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)"),
    )
    return total.cast("long")


def whitened(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, n = indexed(grid(embeddings, column))
    found = fit(rows, n, components) if n else None
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    if found is None:
        return embeddings.sparkSession.createDataFrame(
            [],
            f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double",
        )
    dim, usable = len(found.sums), len(found.values)
    matrix = _matrix(rows, _centred(found.mean), rows.count(), dim)
    weights = Matrices.dense(dim, usable, found.whitening.flatten(order="F"))
    context = embeddings.sparkSession.sparkContext
    weights = BlockMatrix(context.parallelize([((0, 0), weights)], 1), dim, usable)
    projected = matrix.multiply(weights).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = MLUtils.convertVectorColumnsToML(projected, "vector")
    projected = stored(projected.select("index", vector_to_array("vector").alias("values")), "projected")
    fit_projected = projected.where(F.col("index") < n)
    means = fit_projected.select(*(F.avg(F.col("values")[i]).alias(str(i)) for i in range(usable))).first()
    centred = F.zip_with("values", F.lit([float(m) for m in means]), lambda v, m: v - m)
    covariance = _scatter(_matrix(fit_projected, centred, n, usable)) / n
    error = float(np.abs(covariance - np.eye(usable)).max())
    explained = F.lit([float(v / found.trace) for v in found.values])
    return (
        rows.select("index", "vec_id", deviation(found).alias("deviation"))
        .join(projected, "index")
        .select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).alias("component"),
            F.lit(found.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(explained, F.col("at") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
