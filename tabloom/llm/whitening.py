"""Whitening of vectors: centred rows as a distributed BlockMatrix, its scatter, and the rows projected.

The integer rows get a dense index from one count per written part. The centred rows become blocks of ``BLOCK_ROWS`` rows; the
transpose times the matrix is the scatter, a matrix of dimensions squared that alone reaches the driver. Its eigenvectors, over
the roots of their eigenvalues, are the whitening matrix; the blocks times that matrix are the whitened rows.

Defined cases: rows with a null vector, or a null or non-finite entry, are dropped; a vector shorter than the longest counts as if
it went on with entries of 0; rows without an id stay (vec_id null), repeated rows count each time; ``deviation`` is null where it
leaves the range of a long. A component without variance has ``explained`` 0 and ``whitened`` null, and ``identity_error`` is
taken over the others (0 if there is none). Empty vectors alone, or an empty table, give an empty result. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, functions as F

from tabloom.sources.runtime import materialize

BLOCK_ROWS = 1024
#: Blocks that one task holds or multiplies.
PART_BLOCKS = 64
#: An eigenvalue below this share of the sum of all counts as none.
NO_VARIANCE = 1e-12
#: Fixed values of the contract: entries become floor(SCALE * c) + SHIFT; the components returned.
SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8


def _quantise(scale: float, shift: int):
    """(vec_id, x) of the rows whose vectors are whole and finite."""
    def run(batches):
        for batch in batches:
            ids, vectors = batch.columns
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0)).astype(np.int64)
            cells = vectors.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), sizes)
            good = np.asarray(vectors.is_valid()).copy()
            good[owner[~np.isfinite(cells)]] = False  # a null entry is read as not a number
            x = np.clip(np.floor(scale * cells[good[owner]]), -(2.0**62), 2.0**62).astype(np.int64) + shift
            ends = np.concatenate([[0], np.cumsum(sizes[good])])
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))], names=["vec_id", "x"])

    return run


def integer_rows(embeddings: DataFrame, scale: float, shift: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, x and a dense _index from 0; the rows are written once, so the index stays what it is."""
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    x = rows.mapInArrow(_quantise(scale, shift), f"vec_id {kind}, x array<long>")
    place = F.monotonically_increasing_id()
    written = materialize(x.select("vec_id", "x", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "integers")
    counts = written.groupBy("_part").count().orderBy("_part").collect()  # one row for every written part
    before = np.concatenate([[0], np.cumsum([r["count"] for r in counts])])
    starts = written.sparkSession.createDataFrame([(r["_part"], int(b)) for r, b in zip(counts, before)], "_part long, _start long")
    return written.join(F.broadcast(starts), "_part").select("vec_id", "x", (F.col("_start") + F.col("_at")).alias("_index"))


def _padded(vectors: pa.Array, dims: int, shift: int) -> np.ndarray:
    x = np.full((len(vectors), dims), shift, np.int64)
    sizes = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    flat = vectors.flatten().to_numpy()
    owner = np.repeat(np.arange(len(vectors)), sizes)
    x[owner, np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[owner]] = flat
    return x


def _part_sums(dims: int, shift: int):
    """A batch's sums per dimension, of the upper and the lower 32 bits, so that none can leave a long."""
    def run(batches):
        for batch in batches:
            x = _padded(batch.column(0), dims, shift)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], names=["j", "high", "low"])

    return run


def exact_sums(rows: DataFrame, dims: int, shift: int) -> list[int]:
    parts = rows.select("x").mapInArrow(_part_sums(dims, shift), "j long, high long, low long")
    total = (F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low"))
    found = {r["j"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.groupBy("j").agg(*total).collect()}
    return [found[j] for j in range(dims)]


def _block(sums: list[int], n: int, shift: int):
    """x - S/n of a block's rows. The whole part of the mean is taken off as an integer, so nothing is lost to its size."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])

    def run(key, rows):
        rows = rows.sort_by("_index").combine_chunks()
        v = (_padded(pa.concat_arrays(rows.column("x").chunks), len(sums), shift) - whole) - rest
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "entries": pa.array([v.tobytes(order="F")], pa.binary())})

    return run


def _deviations(sums: list[int], n: int, shift: int):
    """The squared distance of n x from the sums, exact: arithmetic of 64 bits that may wrap on the way, but not in the end."""
    near, wrapped = np.array(sums, np.float64), np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)

    def run(batches):
        for batch in batches:
            ids, vectors, index = batch.columns
            x = _padded(vectors, len(sums), shift)
            far = ((n * x.astype(np.float64) - near) ** 2).sum(axis=1) >= 2.0**63 - 2.0**53
            exact = ((n * x - wrapped) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, index, pa.array(exact, pa.int64(), mask=far)], names=["vec_id", "_index", "deviation"])

    return run


def block_matrix(rows: DataFrame, n: int, sums: list[int], shift: int) -> BlockMatrix:
    """Blocks of the centred rows, kept while they are used; what is lost of them is made again from the written rows."""
    n_blocks, dims = -(-n // BLOCK_ROWS), len(sums)
    tasks = max(-(-n_blocks // PART_BLOCKS), rows.sparkSession.sparkContext.defaultParallelism)
    number = F.floor(F.col("_index") / BLOCK_ROWS).cast("int").alias("block")
    made = rows.select("_index", "x", number).repartition(tasks, "block").groupBy("block").applyInArrow(_block(sums, n, shift), "block int, entries binary")

    def matrix(row):
        entries = np.frombuffer(row["entries"])
        return (row["block"], 0), Matrices.dense(len(entries) // dims, dims, entries)

    return BlockMatrix(made.rdd.map(matrix), BLOCK_ROWS, dims, n, dims).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(blocks: BlockMatrix, parts: int) -> np.ndarray:
    """The transpose times the matrix. The rows are the inner dimension, so they are cut into ``parts`` that are multiplied
    apart and then added; the Scala method takes that number, Python's passes one argument."""
    left = blocks.transpose()
    made = left._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, left.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
           vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, scale, shift, vec_id, embedding)
    kind = rows.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dims:
        return spark.createDataFrame([], result)
    sums = exact_sums(rows, dims, shift)

    blocks = block_matrix(rows, n, sums, shift)
    parts = min(blocks.numRowBlocks, max(-(-blocks.numRowBlocks // PART_BLOCKS), spark.sparkContext.defaultParallelism))
    covariance = scatter(blocks, parts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    total = float(np.trace(covariance))
    alive = np.flatnonzero(values > NO_VARIANCE * total) if total > 0 else np.zeros(0, np.int64)
    weights = np.zeros((dims, len(values)))
    weights[:, alive] = vectors[:, alive] / np.sqrt(values[alive])

    matrix = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, len(values), weights.ravel(order="F").tolist()))], 1),
                         dims, len(values))
    made = blocks.multiply(matrix).blocks.flatMap(
        lambda b: [(b[0][0] * BLOCK_ROWS + i, w) for i, w in enumerate(b[1].toArray().tolist())])
    projected = materialize(spark.createDataFrame(made, "_index long, w array<double>"), "projected")
    error = identity_error(projected, n, [int(a) for a in alive])

    facts = rows.mapInArrow(_deviations(sums, n, shift), f"vec_id {kind}, _index long, deviation long")
    w = [F.col("w")[k] if k in alive else F.lit(None).cast("double") for k in range(len(values))]
    share = [float(v / total) if k in alive else 0.0 for k, v in enumerate(values)]
    cells = F.array(*[F.struct(F.lit(k + 1).alias("component"), w[k].alias("whitened"), F.lit(share[k]).alias("explained")) for k in range(len(values))])
    return facts.join(projected, "_index").select("vec_id", "deviation", F.explode(cells).alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).alias("identity_error"))


def identity_error(projected: DataFrame, n: int, alive: list[int]) -> float:
    """Largest entry of the whitened rows' covariance, centred before multiplying, less the identity."""
    if not alive:
        return 0.0
    means = projected.agg(*[F.avg(F.col("w")[k]) for k in alive]).first()
    centred = {k: F.col("w")[k] - F.lit(float(m)) for k, m in zip(alive, means, strict=True)}
    pairs = [(a, b) for a in alive for b in alive if a <= b]
    sums = projected.agg(*[F.sum(centred[a] * centred[b]) for a, b in pairs]).first()
    return float(max(abs(s / n - (a == b)) for s, (a, b) in zip(sums, pairs, strict=True)))
