"""Whitening of vectors from a covariance that is worked out in tiles.

The dimensions are cut into blocks of columns, and a pair of such blocks is a tile of the
covariance. Batches of rows become one array for each block of columns, which goes to all tiles
that it belongs to; a task centres the two arrays of a batch that meet in a tile and multiplies
them. The products are added up in a tree, tile by tile, and the assembled matrix, dimensions by
dimensions, is decomposed by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage, task_number, tree_sum

#: Columns of a block, and rows of an array.
COLUMNS, ROWS = 32, 4096
COMPONENTS = 32
#: What entries become: floor(STEPS * c) + OFFSET; STEPS * c beyond LARGEST stays at it, where doubles stop to hold all integers.
STEPS, OFFSET, LARGEST = 64, 1_000_000, float(1 << 53)
#: Eigenvalues below this part of the largest are rounding: their components have no direction.
RANK = 1e-12


def integral(vectors: DataFrame) -> DataFrame:
    """vec_id, x of the rows of vectors (vec_id, embedding) that can be used: floor(64 c) + 1000000 of each entry c.

    Left out are null vectors, those with null or non-finite entries or without entries, and
    those of another length than most have (the longer of two that are as frequent).
    """
    finite = "size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(finite)
    steps = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * STEPS))).cast("long") + OFFSET)
    whole = stage(rows.select("vec_id", steps.alias("x")), "integral")
    usual = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return whole.filter(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of rows and the sums of x of a task, in two halves that stay within 64 bits."""
    n, high, low = 0, 0, 0
    for batch in (b for b in batches if b.num_rows):
        x = _matrix(batch.column("x"))
        n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high.tolist()]), pa.array([low.tolist()])], names=["n", "high", "low"])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows (x) and the exact sum of each dimension."""
    parts = stage(rows.select("x").mapInArrow(_halves, "n long, high array<long>, low array<long>"), "sums")
    n = parts.agg(F.sum("n")).first()[0] or 0
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    each = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("pos", "s")).select("pos", "s.high", "s.low").groupBy("pos").agg(*wide).orderBy("pos").collect()
    return n, [(int(r["high"]) << 32) + int(r["low"]) for r in each]


def _columns(name: str, offset: int, blocks: int):
    """Batches of rows to arrays (array, tile, side, kind, numbers), each block of columns once for each tile that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task_number() << 32
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            x = _matrix(batch.column(name))
            if x.dtype != np.float64:  # as few bytes as hold them
                x = x - offset
                x = x.astype(np.result_type(np.min_scalar_type(int(x.min())), np.min_scalar_type(int(x.max())), np.int8))
            out = []
            for b in range(blocks):
                own = np.ascontiguousarray(x[:, b * COLUMNS : (b + 1) * COLUMNS]).tobytes()
                out += [(made, other * blocks + b, 1, x.dtype.name, own) for other in range(b + 1)]
                out += [(made, b * blocks + other, 0, x.dtype.name, own) for other in range(b + 1, blocks)]
            made += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["array", "tile", "side", "kind", "numbers"])

    return run


def covariance(rows: DataFrame, name: str, centre: np.ndarray, n: int, offset: int = 0) -> np.ndarray:
    """The covariance of the n arrays of rows in column name, all as long as centre, their mean less offset; the divisor is n."""
    size = len(centre)
    blocks = -(-size // COLUMNS)

    def product(table: pa.Table) -> pa.Table:
        tile, sides = table.column("tile")[0].as_py(), {}
        for r in table.to_pylist():
            at = tile // blocks if r["side"] == 0 else tile % blocks
            mean = centre[at * COLUMNS : (at + 1) * COLUMNS]
            sides[r["side"]] = np.frombuffer(r["numbers"], r["kind"]).reshape(-1, len(mean)) - mean
        both = sides.get(0, sides[1]).T @ sides[1]  # a tile on the diagonal has one block
        return pa.table({"tile": pa.array([tile], pa.int32()), "numbers": pa.array([both.tobytes()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for tile, numbers in zip(batch.column("tile").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                total[tile] = total.get(tile, 0) + np.frombuffer(numbers)
        numbers = pa.array([t.tobytes() for t in total.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([task_number()] * len(total), pa.int32()), pa.array(list(total), pa.int32()), numbers], names=["part", "tile", "numbers"])

    arrays = rows.select(name).mapInArrow(_columns(name, offset, blocks), "array long, tile int, side int, kind string, numbers binary")
    products = arrays.groupBy("array", "tile").applyInArrow(product, "tile int, numbers binary")
    out = np.zeros((size, size))
    for r in tree_sum(products.mapInArrow(added, "part int, tile int, numbers binary"), "float64").collect():  # dimensions by dimensions in all
        i, j = (k * COLUMNS for k in divmod(r["tile"], blocks))
        own = np.frombuffer(r["numbers"]).reshape(-1, min(COLUMNS, size - j))
        out[i : i + len(own), j : j + own.shape[1]] = own
        out[j : j + own.shape[1], i : i + len(own)] = own.T
    return out / n


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """n x - S in doubles and its exact sum of squares in each row; Python's integers where 64 bits are too few."""
    largest = n * int(np.abs(x).max()) + max(abs(s) for s in sums)
    if largest < 1 << 62:
        y = x * n - sums.astype(np.int64)
        if int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
            return y.astype(np.float64), (y * y).sum(axis=1).tolist()
        exact = y.astype(object)
    else:
        exact = x.astype(object) * n - sums
    return exact.astype(np.float64), (exact * exact).sum(axis=1).tolist()


def _whitened(n: int, sums: list[int], project: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact_sums = np.array(sums, dtype=object)
        for batch in (b for b in batches if b.num_rows):
            y, squares = _squares(_matrix(batch.column("x")), n, exact_sums)
            w = y / n @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            deviation = pa.array([str(s) if s < 10**38 else None for s in squares], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return run


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of vectors and each component.

    Entries become integers x (see integral(), which says what rows are left out); all rows
    left are the n that the covariance of x is of. Components are its unit eigenvectors, from 1 by
    falling eigenvalue e, up to components; those whose e is no more than rounding have no
    direction and are left out. whitened is x - S/n projected on the component over sqrt(e),
    explained e over the sum of all, deviation the exact sum of (n x - S)^2 over the dimensions as decimal
    (null beyond 38 digits), identity_error the largest entry of the covariance of whitened less
    the identity. Repeated rows count each, null vec_ids stay, other columns are ignored. An empty
    table, or vectors that are all equal, give no rows.
    """
    spark, rows = vectors.sparkSession, integral(vectors)
    n, total = sums(rows)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    mean = np.array([(s - n * OFFSET) / n for s in total])
    values, directions = np.linalg.eigh(covariance(rows, "x", mean, n, OFFSET))
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > RANK * max(values.max(), 0)]
    if not order:
        return spark.createDataFrame([], schema)
    project = directions[:, order] / np.sqrt(values[order])
    told = stage(rows.mapInArrow(_whitened(n, total, project), "vec_id long, deviation string, whitened array<double>"), "whitened")
    error = float(np.abs(covariance(told, "whitened", np.zeros(len(order)), n) - np.eye(len(order))).max())  # their mean is 0
    explained = F.array(*[F.lit(float(values[k] / values.sum())) for k in order])
    each = told.select("vec_id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
