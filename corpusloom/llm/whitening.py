"""Whitening of embeddings with MLlib's BlockMatrix.

Rows are put into numbered blocks of a fixed height, once, and written; padded rows are zero after centring and so add nothing. As a tall
matrix of one block column, the centred blocks are transposed and multiplied by themselves, the middle dimension split over the cores, which
gives the scatter matrix; its eigenvectors are a small local problem. For the projection the same blocks are laid out as a square grid, and the
multiplier holds the whitening matrix in each block of its diagonal, so that the product is spread over all cores and each block moves once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import materialise

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Numbers of a block, so of the order of a megabyte each.
BLOCK = 1 << 17


def finite(column: str = "embedding"):
    """Whether a vector takes part: not null or empty, no null or non-finite entry."""
    v = F.col(column)
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~wrong, F.lit(False))


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums down the columns of a matrix of whole numbers, whatever their size."""
    small = not x.size or float(np.abs(x).max()) * len(x) < 2.0**62
    return [int(v) for v in (x if small else x.astype(object)).sum(axis=0)]


def _blocked(vectors: DataFrame, dims: int, height: int) -> DataFrame:
    """(part, nth, ids, rows, x): blocks of ``height`` vectors in whole numbers, the last one of a task padded."""
    kind = vectors.schema[0].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, size = None, 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            x = np.zeros((height, dims), dtype=np.int64)
            x[: rows.num_rows] = np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, dims)
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows["id"].combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), ids, pa.array([rows.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "nth", "ids", "rows", "x"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
                held.append(batch)
                size += batch.num_rows
            while size >= height:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, height))
                nth, size, held = nth + 1, size - height, table.slice(height).to_batches()
        if size:
            yield block(pa.Table.from_batches(held))

    return vectors.mapInArrow(build, f"part int, nth int, ids array<{kind}>, rows int, x binary")


def _matrix(blocks: DataFrame, width: int, height: int, mean: np.ndarray, kind: str, columns: int) -> BlockMatrix:
    """Centred blocks as a matrix: block number b stands at (b // columns, b % columns)."""

    def centred(row):
        values = np.frombuffer(row.x, dtype=kind).reshape(height, width).astype(np.float64)
        out = np.zeros((height, width))
        out[: row.rows] = values[: row.rows] - mean
        return (row.b // columns, row.b % columns), DenseMatrix(height, width, out.T.ravel())

    return BlockMatrix(blocks.select("b", "rows", "x").rdd.map(centred), height, width)


def scatter(tall: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix. Scala's multiply takes a number of splits of the middle dimension, Python's wrapper doesn't pass it on; without it
    one task would get all blocks."""
    flipped = tall.transpose()
    product = flipped._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, flipped.rowsPerBlock, tall.colsPerBlock).toLocalMatrix().toArray()


def whitened(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per vector and component, ``most`` components at most.

    Vectors that are null, empty, or hold a null or non-finite entry take no part, nor do those of another length than the most frequent (of equals, the
    largest) or with entries that pass 62 bits when scaled. All others do, whatever their id; equal rows each have rows of their own. Directions whose
    variance is zero to double precision have no whitened value and no rows, so equal vectors, a single one and empty tables give none. A
    deviation beyond 64 bits is null. Further columns are ignored.
    """
    session = vectors.sparkSession
    cores = session.sparkContext.defaultParallelism
    rows = vectors.where(finite(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(~F.exists("v", lambda c: F.abs(c) * SCALE >= 2.0**62))
    id_type = rows.schema["id"].dataType.simpleString()
    nothing = session.createDataFrame([], f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return nothing
    dims, n = length.d, length.n
    height = max(BLOCK // dims, 1)
    numbers = F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT)
    blocks = materialise(_blocked(rows.where(F.size("v") == dims).select("id", numbers.alias("x"), F.spark_partition_id().alias("part")), dims, height), "white-blocks")
    # one row per task: its number of blocks, and how many stand before
    sizes = blocks.groupBy("part").agg((F.max("nth") + 1).alias("k")).orderBy("part").collect()
    before, total = [], 0
    for s in sizes:
        before.append((s.part, total))
        total += s.k
    offsets = session.createDataFrame(before, "part int, first long")
    # blocks are large and tasks few: the offsets are one row per task
    numbered = materialise(blocks.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("nth")).alias("b"), "ids", "rows", "x").repartition(max(cores, min(total, 4 * cores)), "b"), "white-numbered")

    def sums(batches):
        held = [0] * dims
        for batch in batches:
            for rows, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = [a + b for a, b in zip(held, exact_sum(np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(height, dims)[:rows]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(v) for v in held])], names=["d", "s"])

    added = numbered.select("rows", "x").mapInArrow(sums, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    whole = [int(r.s) for r in added.orderBy("d").collect()]
    mean = np.array([(s // n) + (s % n) / n for s in whole])
    tall = _matrix(numbered, dims, height, mean, "<i8", 1)
    covariance = scatter(tall, max(1, min(total, cores))) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    k = int((values[:most] > max(dims, 8) * np.finfo(float).eps * max(values[0], 0.0)).sum())
    if not k:
        return nothing
    whitening = directions[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / np.trace(covariance)

    side = max(1, math.isqrt(total - 1) + 1)
    grid = _matrix(numbered, dims, height, mean, "<i8", side)
    diagonal = session.sparkContext.parallelize(range(side), min(side, cores)).map(lambda j: ((j, j), DenseMatrix(dims, k, whitening.T.ravel())))
    product = grid.multiply(BlockMatrix(diagonal, dims, k))
    flat = product.blocks.map(lambda e: (e[0][0] * side + e[0][1], bytearray(np.ascontiguousarray(e[1].toArray()).tobytes())))
    projected = numbered.select("b", "ids", "rows", F.col("x").alias("whole")).join(flat.toDF("b long, x binary"), "b")
    projected = materialise(projected, "white-projected")

    def column_sums(batches):
        total = np.zeros(k)
        for batch in batches:
            for rows, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.frombuffer(x.as_buffer()).reshape(height, k)[:rows].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["d", "s"])

    centre = projected.select("rows", "x").mapInArrow(column_sums, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).orderBy("d").collect()
    again = scatter(_matrix(projected, k, height, np.array([r.s for r in centre]) / n, "<f8", 1), max(1, min(total, cores))) / n
    error = float(np.abs(again - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        rough = ((n * x.astype(np.float64) - np.array(whole, dtype=np.float64)) ** 2).sum(axis=1)
        out = []
        exact = x * np.int64(n) - np.array(whole, dtype=np.int64) if float(np.abs(x).max(initial=0)) * n < 2.0**62 and max(map(abs, whole)) < 2**62 else None
        for i, r in enumerate(rough.tolist()):
            if exact is not None and r < 2.0**62:
                out.append(int((exact[i] ** 2).sum()))
            else:
                value = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], whole, strict=True))
                out.append(value if value < 1 << 63 else None)
        return out

    def spread(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                count, ids = batch.column(1)[b].as_py(), batch.column(0).slice(b, 1).flatten()
                x = np.frombuffer(batch.column(2)[b].as_buffer(), dtype=np.int64).reshape(height, dims)[:count]
                y = np.frombuffer(batch.column(3)[b].as_buffer()).reshape(height, k)[:count]
                each = np.repeat(np.arange(count), k)
                columns = [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, n, dtype=np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(explained, count)), pa.array(np.full(count * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return projected.select("ids", "rows", "whole", "x").mapInArrow(spread, nothing.schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumnRenamed("id", "vec_id")
