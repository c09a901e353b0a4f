"""Whitening of embeddings by Spark MLlib's BlockMatrix.

Entries become integers, x = floor(64 c) + 1000000, so that counts and sums per dimension are exact. Rows are packed into
numbered blocks where Spark read them, without a shuffle. Centred rows, (n x - S) / n with one rounding, are the blocks of
a tall BlockMatrix; its transpose times itself is the scatter, whose products are dealt over many parts of the inner
dimension and summed block by block. The eigenvectors of the covariance are found on the driver (a matrix as wide as a
vector is long). For the projection the same blocks lie on a square grid beside a block-diagonal whitening matrix: each
block meets one copy of it, and MLlib's grid partitioner, which gives a tall matrix only the square root of the
partitions asked for, spreads a square one over all of them. MLlib plans a product on the driver from the blocks' index
pairs, two integers for BLOCK_BYTES of vectors.

Defined cases: vectors that are null, hold null or non-finite entries, or have fewer entries than the longest one that
holds none (what is missing counts as null) take no part; rows that repeat an id are rows of their own, a null id stays
null; components whose eigenvalue is below NO_VARIANCE of the largest (constant dimensions, fewer rows than dimensions)
have a null whitened value and are left out of the identity error, which is null if no component is left; entries of
2**47 or more in size, and deviations beyond a long, raise an error; an empty table, or empty vectors alone, give an
empty result; columns beside the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from lapwise.llm.scratch import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 2 << 20
BLOCKS_A_TASK = 8
NO_VARIANCE = 1e-11
LARGEST = 1 << 62

INDEX = T.StructType([T.StructField("_1", T.LongType(), False), T.StructField("_2", T.LongType(), False)])
BLOCK = T.StructType([T.StructField("blockIndex", INDEX, False), T.StructField("subMatrix", MatrixUDT(), False)])
#: How a matrix column is laid out in Arrow: the fields of MLlib's matrix type.
PLACE = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
MATRIX = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])


def usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """id and x (whole numbers) of the vectors that take part, and their number of entries."""
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull() & finite)
    dims = whole.agg(F.max(F.size("vec"))).first()[0] or 0
    entry = lambda c: F.when(F.abs(c) < 2.0**47, F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large to whiten")))
    x = F.when(finite & (F.size("vec") == dims), F.transform("vec", entry))  # the condition also guards the entries where Spark moves filters
    return whole.select("id", x.alias("x")).where("x IS NOT NULL"), dims


def blocks_of(rows: DataFrame, dims: int, n: int, sums: np.ndarray, block_rows: int) -> DataFrame:
    """number, ids, deviations and packed x of blocks of at most block_rows rows. deviation: sum of (n x - S)**2, exact."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seq = zstandard.ZstdCompressor(level=3), 0
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal seq
            ids = pa.chunked_array([b.column("id") for b in held]).combine_chunks()
            x = np.concatenate([b.column("x").flatten().to_numpy() for b in held]).reshape(-1, dims)
            if int(np.abs(x).max()) * n >= LARGEST:
                raise OverflowError("n x is beyond a long")
            apart = n * x - sums
            if float((apart.astype(np.float64) ** 2).sum(axis=1).max()) >= LARGEST:
                raise OverflowError("a deviation is beyond a long")
            deviation = (apart**2).sum(axis=1)
            lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            packed = pack.compress(np.ascontiguousarray(x.T).tobytes())
            out = pa.RecordBatch.from_arrays([held[0].column("part").slice(0, 1), pa.array([seq], pa.int64()), lists(ids), lists(pa.array(deviation)), pa.array([packed], pa.binary())], names=["part", "seq", "ids", "deviations", "x"])
            seq += 1
            held.clear()
            return out

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, block_rows - sum(b.num_rows for b in held))
                batch = batch.slice(part.num_rows)
                held.append(part)
                if sum(b.num_rows for b in held) == block_rows:
                    yield block()
        if held:
            yield block()

    placed = rows.withColumn("part", F.spark_partition_id().cast("long"))
    found = written(placed.mapInArrow(run, f"part long, seq long, ids array<{kind}>, deviations array<long>, x binary"), "vector-blocks")
    counts = found.groupBy("part").agg(F.count(F.lit(1)).alias("n_blocks"))  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n_blocks").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return found.join(starts, "part").select((F.col("start") + F.col("seq")).alias("number"), "ids", "deviations", "x")


def matrix_batch(row: int, col: int, values: np.ndarray) -> pa.RecordBatch:
    """One dense block as a row of a BLOCK table."""
    flat = pa.array(values.ravel(order="F"))
    fields = [pa.array([1], pa.int8()), pa.array([values.shape[0]], pa.int32()), pa.array([values.shape[1]], pa.int32()), pa.nulls(1, MATRIX.field("colPtrs").type), pa.nulls(1, MATRIX.field("rowIndices").type), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.array([False])]
    return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([row]), pa.array([col])], fields=list(PLACE)), pa.StructArray.from_arrays(fields, fields=list(MATRIX))], names=["blockIndex", "subMatrix"])


def centred(blocks: DataFrame, dims: int, n: int, sums: np.ndarray, width: int | None = None) -> DataFrame:
    """The blocks of centred rows: one under another, or from left to right in rows of width blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for number, x in zip(batch.column("number").to_pylist(), batch.column("x"), strict=True):
                rows = np.frombuffer(unpack.decompress(x.as_buffer()), dtype=np.int64).reshape(dims, -1).T
                place = (number, 0) if width is None else divmod(number, width)
                yield matrix_batch(*place, (n * rows - sums) / n)

    return blocks.select("number", "x").mapInArrow(run, BLOCK)


def block_matrix(blocks: DataFrame, rows_per_block: int, cols_per_block: int, rows: int, cols: int) -> Any:
    """MLlib's block matrix (of the JVM) over a BLOCK table."""
    return callMLlibFunc("createBlockMatrix", blocks, rows_per_block, cols_per_block, rows, cols)


def scatter(blocks: DataFrame, count: int, dims: int, n: int, sums: np.ndarray, block_rows: int) -> np.ndarray:
    """Transpose times matrix of the centred rows; a task multiplies about BLOCKS_A_TASK blocks."""
    tall = block_matrix(centred(blocks, dims, n, sums), block_rows, dims, count * block_rows, dims)
    return BlockMatrix(tall.transpose().multiply(tall, max(1, -(-count // BLOCKS_A_TASK))), dims, dims).toLocalMatrix().toArray()


def spectrum(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors, each with its largest entry positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1][:most], 0), vectors[:, ::-1][:, :most]
    return values, vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0) < 0, -1.0, 1.0)


def project(blocks: DataFrame, count: int, dims: int, n: int, sums: np.ndarray, weights: np.ndarray, block_rows: int) -> DataFrame:
    """number and z: the centred rows of each block times weights, as the bytes of doubles, column by column."""
    spark, width, m = blocks.sparkSession, max(1, int(np.ceil(np.sqrt(count)))), weights.shape[1]
    height = -(-count // width)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("k").to_pylist():
                yield matrix_batch(k, k, weights)

    grid = block_matrix(centred(blocks, dims, n, sums, width), block_rows, dims, height * block_rows, width * dims)
    tasks = max(1, -(-count // BLOCKS_A_TASK))
    diagonal = block_matrix(spark.range(0, width, 1, tasks).withColumnRenamed("id", "k").mapInArrow(copies, BLOCK), dims, m, width * dims, width * m)
    product = callMLlibFunc("getMatrixBlocks", grid.multiply(diagonal)).toDF("place", "matrix")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, found = batch.column("place").to_pylist(), batch.column("matrix")
            for i, place in enumerate(places):
                one = found[i]
                values = one["values"].values.to_numpy().reshape(one["numCols"].as_py(), one["numRows"].as_py())  # a dense product is laid out by columns
                yield pa.RecordBatch.from_arrays([pa.array([place["_1"] * width + place["_2"]], pa.int64()), pa.array([values.tobytes()], pa.binary())], names=["number", "z"])

    return product.mapInArrow(flat, "number long, z binary")


def _moments(z: DataFrame, m: int, means: np.ndarray | None = None) -> np.ndarray:
    """Sums of z per component or, about means, sums of products per pair of components; partial sums per task."""
    size = m if means is None else m * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for one in batch.column("z"):
                values = np.frombuffer(one.as_buffer(), dtype=np.float64).reshape(m, -1)
                if means is None:
                    total += values.sum(axis=1)
                else:
                    apart = values - means[:, None]
                    total += (apart @ apart.T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    found = z.select("z").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
    return found.column("value").to_numpy()


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """A row for every vector that takes part and every component up to components.

    key, component, n, deviation, whitened, explained and identity_error, as the module describes them. block_rows: rows of
    a block, by default BLOCK_BYTES of doubles.
    """
    spark = vectors.sparkSession
    rows, dims = usable(vectors, key, column)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    totals = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").toArrow() if dims else None
    if totals is None or not totals.num_rows:
        return spark.createDataFrame([], schema)
    n, sums = totals.column("n")[0].as_py(), totals.column("s").to_numpy()
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * dims))
    blocks = written(blocks_of(rows, dims, n, sums, block_rows), "numbered-blocks")
    count, m = blocks.count(), min(components, dims)
    covariance = scatter(blocks, count, dims, n, sums, block_rows) / n
    values, axes = spectrum(covariance, m)
    live = values > NO_VARIANCE * values[0] if values[0] > 0 else np.zeros(m, dtype=bool)
    weights = np.where(live, axes / np.sqrt(np.where(live, values, 1)), 0.0)
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else None
    z = written(project(blocks, count, dims, n, sums, weights, block_rows), "whitened-blocks")
    error = None
    if live.any():
        again = _moments(z, m, _moments(z, m) / n).reshape(m, m) / n
        error = float(np.abs((again - np.eye(m))[np.ix_(live, live)]).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, deviations = batch.column("ids")[i].values, batch.column("deviations")[i].values
                whitened = np.frombuffer(batch.column("z")[i].as_buffer(), dtype=np.float64).reshape(m, -1).T.ravel()
                size = len(ids) * m
                each = pa.array(np.repeat(np.arange(len(ids)), m))
                tiled = lambda x: pa.nulls(size, pa.float64()) if x is None else pa.array(np.tile(x, len(ids)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [ids.take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(ids))), pa.array(np.full(size, n)), deviations.take(each), pa.array(whitened, mask=~np.tile(live, len(ids))), tiled(explained), pa.nulls(size, pa.float64()) if error is None else pa.array(np.full(size, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.select("number", "ids", "deviations").join(z, "number").select("ids", "deviations", "z").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
