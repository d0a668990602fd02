"""Approximate nearest neighbours: an inverted file of centroids with codes of the residuals.

Centroids are fitted on a sample of SAMPLE vectors for each of them; every vector is indexed, in the
list of its nearest centroid, as int8 steps of what the centroid leaves. A search reads the
lists nearest to its queries, ranks their vectors by codes, and compares the best ones with the
vectors themselves. How many lists that takes is measured when the index is written: AUDITED
vectors are compared with all others, and as many lists are read as hold RECALL of their best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import rounded
from lodestone.functions.vectors import dot, unit
from lodestone.operators.dense import NEAREST, NONE, best_of, dense_topk, matrix
from lodestone.operators.lexical import ranked
from lodestone.session import scratch

#: Vectors a centroid is fitted on, numbers in all centroids at most, rounds of the fit.
SAMPLE, CENTROID_NUMBERS, ROUNDS = 64, 1 << 22, 10
#: Vectors that the number of lists is measured with, their best ones that count, and the part of these to be found.
AUDITED, AUDIT_K, RECALL = 512, 10, 0.98
#: Candidates compared exactly, for each result.
WIDER = 8
#: Rows of a list, or queries of a list, that meet in one task.
LIST_ROWS, LIST_QUERIES = 1 << 16, 1 << 13
_ROWS = "chunk_idx long, embedding array<float>, code array<tinyint>, scale double, list int"


@dataclass(frozen=True)
class VectorIndex:
    """rows: list, chunk_idx, embedding, code, scale; sizes: list, n."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int


def _nearest_lists(centroids, names: list[str], n: int):
    """Rows (names, embedding) to (names, embedding, list, base, place), a row for each of the n nearest centroids, from place 0; base is the product with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centroids.value
        half = (known**2).sum(axis=1) / 2
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            products = matrix(pa.chunked_array([batch.column("embedding")]))[0] @ known.T
            near = np.argsort(half - products, axis=1, kind="stable")[:, :n]
            row = np.repeat(np.arange(batch.num_rows), near.shape[1])
            lists = near.ravel()
            place = np.tile(np.arange(near.shape[1], dtype=np.int32), batch.num_rows)
            made = [pa.array(lists.astype(np.int32)), pa.array(products[row, lists]), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, *made], names=[*names, "embedding", "list", "base", "place"])

    return run


def _coded(centroids):
    """The residuals of vectors as int8 steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = centroids.value
        for batch in batches:
            rest = matrix(pa.chunked_array([batch.column("embedding")]))[0] - known[batch.column("list").to_numpy()]
            scale = np.abs(rest).max(axis=1, initial=0) / 127
            scale[scale == 0] = 1.0
            steps = np.rint(rest / scale[:, None]).astype(np.int8)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(steps) + 1, dtype=np.int32) * steps.shape[1]), pa.array(steps.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("chunk_idx"), batch.column("embedding"), code, pa.array(scale)], names=["list", "chunk_idx", "embedding", "code", "scale"])

    return run


def write_vector_index(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 1) -> None:
    """The index of vectors (chunk_idx, embedding of unit length; null ones are left out) below path.

    lists: how many; without it the root of the number of vectors.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("embedding").cast("array<float>").alias("embedding")).filter("embedding is not null")
    shape = own.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    size = max(1, shape["d"] or 1)
    wanted = max(1, min(lists or round(shape["n"] ** 0.5), CENTROID_NUMBERS // size, shape["n"]))
    if shape["n"]:
        part = min(1.0, SAMPLE * wanted / shape["n"])
        some = own.filter(F.pmod(F.xxhash64("chunk_idx"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else own
        points = some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        centroids = np.array(KMeans(k=wanted, seed=seed, maxIter=ROUNDS).fit(points).clusterCenters())
    else:
        centroids = np.zeros((1, size))
    table = [(k, c.tolist()) for k, c in enumerate(centroids)]  # CENTROID_NUMBERS at most
    spark.createDataFrame(table, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    sent = spark.sparkContext.broadcast(centroids)
    placed = own.mapInArrow(_nearest_lists(sent, ["chunk_idx"], 1), "chunk_idx long, embedding array<float>, list int, base double, place int").drop("base", "place")
    coded = placed.mapInArrow(_coded(sent), "list int, chunk_idx long, embedding array<float>, code array<tinyint>, scale double")
    salt = F.pmod(F.xxhash64("chunk_idx"), F.lit(max(1, -(-shape["n"] // LIST_ROWS))))  # a list that holds most vectors is no single task
    coded.repartition("list", salt).sortWithinPartitions("list", "chunk_idx").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    audited = min(1.0, AUDITED / max(1, shape["n"]))
    asked = own.filter(F.pmod(F.xxhash64("chunk_idx", F.lit(seed)), F.lit(1 << 30)) < int(audited * (1 << 30))).select(F.col("chunk_idx").alias("query_id"), "embedding")
    best = dense_topk(own, asked, AUDIT_K).select("query_id", "chunk_idx").join(rows.select("chunk_idx", "list"), "chunk_idx")
    places = asked.mapInArrow(_nearest_lists(sent, ["query_id"], wanted), "query_id long, embedding array<float>, list int, base double, place int")
    needed = best.join(places.select("query_id", "list", "place"), ["query_id", "list"]).agg(F.percentile("place", F.lit(RECALL))).first()[0]
    spark.createDataFrame([(int(needed or 0) + 1,)], "probes int").write.mode("overwrite").parquet(f"{path}/probes")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.schema(_ROWS).parquet(f"{path}/rows")
    table = sorted(spark.read.parquet(f"{path}/centroids").collect())
    return VectorIndex(rows, rows.groupBy("list").agg(F.count("*").alias("n")), np.array([r["centroid"] for r in table]), spark.read.parquet(f"{path}/probes").first()["probes"])


def vector_index(vectors: DataFrame, lists: int | None = None, seed: int = 1) -> VectorIndex:
    """The index of vectors in the session's scratch folder."""
    path = scratch(vectors.sparkSession, "vector-index")
    write_vector_index(vectors, path, lists, seed)
    return read_vector_index(vectors.sparkSession, path)


def approximate_topk(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, chunk_idx, score, rank like dense_topk(), of vectors in the lists nearest to each query.

    queries: query_id, embedding of any length but zero. probes: how many lists, without it as
    many as the index was measured to need; all of them give the exact result but for what the
    codes confuse beyond WIDER times k candidates.
    """
    spark = queries.sparkSession
    lists = len(index.centroids)
    n = min(lists, probes or index.probes)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("embedding")).alias("embedding")).filter("embedding is not null")
    sent = spark.sparkContext.broadcast(index.centroids)
    probing = asked.mapInArrow(_nearest_lists(sent, ["query_id"], n), "query_id long, embedding array<float>, list int, base double, place int").drop("place")
    wanted = probing.groupBy("list").agg(F.count("*").alias("n_asked")).join(index.sizes, "list")
    blocks = wanted.select("list", F.ceil(F.col("n") / LIST_ROWS).alias("row_blocks"), F.ceil(F.col("n_asked") / LIST_QUERIES).alias("query_blocks")).collect()  # a row a list
    if not blocks:
        return spark.createDataFrame([], f"{NEAREST}, rank long")
    table = F.broadcast(spark.createDataFrame(blocks))
    read = index.rows.filter(F.col("list").isin([b["list"] for b in blocks]))

    def dealt(rows: DataFrame, key: str, own_blocks: str, others: str, names: tuple[str, str]) -> DataFrame:
        sized = rows.join(table, "list")
        own = F.pmod(F.xxhash64(key), F.col(own_blocks)).alias(names[0])
        return sized.select(*rows.columns, own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(names[1]))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NONE
        codes, scale = matrix(left.column("code"))[0], left.column("scale").to_numpy()
        return best_of(right.column("query_id").to_numpy(), matrix(right.column("embedding"))[0], left.column("chunk_idx").to_numpy(), codes, scale, WIDER * k, right.column("base").to_numpy())

    def listed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = found(left, right)
        return out.append_column("list", pa.array([left.column("list")[0].as_py()] * out.num_rows if out.num_rows else [], pa.int32()))

    keys = ("list", "row_block", "query_block")
    left = dealt(read.select("list", "chunk_idx", "code", "scale"), "chunk_idx", "row_blocks", "query_blocks", ("row_block", "query_block"))
    right = dealt(probing, "query_id", "query_blocks", "row_blocks", ("query_block", "row_block"))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(listed, f"{NEAREST}, list int")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_idx")
    best = near.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= WIDER * k).select("query_id", "chunk_idx", "list")
    exact = best.join(read.select("list", "chunk_idx", F.col("embedding").alias("own")), ["list", "chunk_idx"]).join(asked, "query_id")
    return ranked(exact.select("query_id", "chunk_idx", rounded(dot(F.col("own"), F.col("embedding"))).alias("score")), k, "chunk_idx")
