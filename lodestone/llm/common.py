"""Staged tables and connected components shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a small table that are broadcast, some hundred bytes each; keys that a hot one is dealt over.
BROADCAST_ROWS, SALTS = 50_000, 32
#: A key is hot if it holds more than one row in so many; so there are at most that many hot keys.
HOT = 1000
_SCRATCH: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is unset, a local session gets one of this machine and any other an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(cleared)
    _SCRATCH.append((spark, path))
    return path


def cleared() -> None:
    """Remove what scratch() has named so far. Results that still read it can't be computed afterwards."""
    for spark, path in _SCRATCH:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder stays
            break
    _SCRATCH.clear()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again.

    It cuts the lineage: a lost executor costs only the tasks that it ran, and what
    several jobs read is computed once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with table, which has one row for each value of key.

    Up to most rows of table are broadcast, after they were counted. Beyond, the rows of one key
    are dealt over SALTS tasks by the column spread, and table is there under each salt, so that
    a key with a third of all rows is no single task.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")


def joined(rows: DataFrame, table: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """rows joined with table, which has one row for each value of on; count tells how many of rows have it.

    Values of more than one row in HOT, at most HOT values, meet their rows by a broadcast; all
    others by a shuffle in which none of them is much. Both tables are read twice, so they
    should be staged. Rows with a null in on are left out.
    """
    most = (table.agg(F.sum(count)).first()[0] or 0) // HOT
    often = table.filter(F.col(count) > max(most, 1))
    if often.isEmpty():
        return rows.join(table, on)
    rare = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(table.filter(F.col(count) <= max(most, 1)), on)
    return rows.join(F.broadcast(often), on).unionByName(rare)


def task_number() -> int:
    """The number of the partition that the running task works on."""
    return TaskContext.get().partitionId()


def combined(parts: DataFrame, combine: Callable[[list[bytes]], bytes], fan: int = 32) -> DataFrame:
    """One row (part 0, tile, numbers) for each tile of parts (part, tile, numbers), whose numbers are combined in a tree.

    part is the number of the task that made the numbers. Those of fan tasks meet in one group at
    a time, round by round, so no group holds more of them.
    """

    def together(table: pa.Table) -> pa.Table:
        numbers = combine(table.column("numbers").to_pylist())
        return pa.table({"part": table.column("part")[:1], "tile": table.column("tile")[:1], "numbers": pa.array([numbers], pa.binary())})

    parts = stage(parts, "parts")
    width = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part", "tile").applyInArrow(together, "part int, tile int, numbers binary")
        width = -(-width // fan)
    return parts


def tree_sum(parts: DataFrame, kind: str, most: int | None = None, fan: int = 32) -> DataFrame:
    """combined() where numbers are arrays of kind that are added up; with most, sums stay at it."""

    def added(arrays: list[bytes]) -> bytes:
        total = sum(np.frombuffer(x, kind).astype(np.float64 if kind == "float64" else np.int64) for x in arrays)
        return (total if most is None else np.minimum(total, most)).astype(kind).tobytes()

    return combined(parts, added, fan)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (src, dst); root is the smallest node reachable.

    Minimum labels spread over the edges and pointers are doubled in every round, so the
    rounds grow with the logarithm of the diameter. Nothing is gathered by component: the
    aggregates are minima, which combine before they are shuffled; nodes of very many edges and
    roots of very many nodes are joined apart from the rest. Self loops and null ends
    are left out.
    """
    pairs = edges.filter("src <> dst")
    both = stage(pairs.select("src", "dst").union(pairs.select("dst", "src")).distinct(), "edges")
    first = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root"), F.count("*").alias("degree"))
    labels = stage(first, "labels")
    while True:
        ends = labels.select(F.col("node").alias("dst"), "root", "degree")  # as many edges end in a node as begin there
        near = joined(both, ends, ["dst"], "degree").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        moved = stage(labels.join(near, "node").select("node", "degree", F.least("root", "near").alias("up"), F.col("root").alias("old")), "moved")
        above = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        tops = stage(moved.groupBy("up").agg(F.count("*").alias("below")).join(above, "up"), "tops")
        labels = stage(joined(moved, tops, ["up"], "below").select("node", "degree", F.least("up", "top").alias("root"), "old"), "labels")
        if labels.filter("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.drop("old")
