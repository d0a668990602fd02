"""A store of embeddings by content: what was embedded once is read, what is new is computed and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STORED = "key string, embedding array<float>"


def embedding_key(text: Column, model: str, dimensions: int) -> Column:
    """The place of a text's embedding: another model or size is another place."""
    return F.sha2(F.concat_ws("\n", F.lit(model), F.lit(str(dimensions)), text), 256)


def stored(spark, path: str) -> DataFrame:
    """key, embedding of a store; one that isn't there yet is empty. A key that was added twice is read once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(f"{STORED}, added string").parquet(path)
    return rows.groupBy("key").agg(F.any_value("embedding").alias("embedding"))


def embedded(texts: DataFrame, path: str, model: str, dimensions: int, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts (text and others) with embedding, from the store in path; null texts have none.

    Each distinct text that the store lacks goes to embed once (key, text to key, embedding), and
    what comes back is added before it is used. An addition is a folder that its own keys name:
    if it is repeated, after a failure or twice at a time, it replaces itself and adds no row.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("key", F.when(F.col("text").isNotNull(), embedding_key(F.col("text"), model, dimensions)))
    missing = keyed.filter("key is not null").groupBy("key").agg(F.any_value("text").alias("text")).join(stored(spark, path), "key", "left_anti")
    told = missing.agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("key"))).alias("name")).first()
    if told["n"]:
        fresh = embed(missing).select("key", F.col("embedding").cast("array<float>").alias("embedding"))
        good = F.assert_true(F.size("embedding") == dimensions, F.lit(f"an embedding of {dimensions} numbers is asked for"))
        fresh.filter(good.isNull()).write.mode("overwrite").parquet(f"{path}/added={told['n']}-{told['name']}")
    return keyed.join(stored(spark, path), "key", "left").drop("key")
