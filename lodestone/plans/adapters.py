"""The test tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: framework is the language, chunk_idx the id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_idx"), F.col("lang").alias("framework"), F.concat_ws(":", "source", "doc_id").alias("citation"),
        F.substring_index("text", "\n", 1).alias("heading"), "source", "text",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    part = F.col("item_id") % 4
    sliced = F.when(part == 2, "paraphrased").when(part == 3, "lookup").otherwise("direct")
    return bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), sliced.alias("slice"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings at unit length."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_idx"), unit(F.col("embedding")).alias("embedding"), F.col("label").alias("framework"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of benchmark item i is vector i."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of a model's use; a run is a user's day."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "retrieve").when(F.col("event_type") == "click", "embed").when(F.col("event_type") == "signup", "rerank").otherwise("generate")
    tokens = F.when((k % 10 != 0) & ~kind.isin("retrieve"), F.floor(F.col("value") * 100).cast("int"))
    model = F.when(kind == "embed", "gemini-embedding-001").when(kind != "retrieve", F.when(F.col("event_id") % 97 == 0, "other").otherwise("gemini-3.6-flash"))
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), kind.alias("kind"), model.alias("model"),
        tokens.alias("input_tokens"), F.floor(tokens / 4).cast("int").alias("output_tokens"), (k % 7 == 0).alias("cached"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("bucket"), F.col("user_id").cast("string").alias("visitor"), at.alias("at_ms"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("report_id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("document_hash"), F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderdate + interval 30 days").alias("expires_at"), (F.col("o_orderstatus") == "P").alias("pinned"), F.col("o_totalprice").alias("total"),
    )


def latest(spark: SparkSession, sf_dir: str):
    """The time that stands for now: the last order's. One aggregate, read as a constant."""
    return F.lit(table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0])


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings; an order is a framework."""
    lines = table(spark, sf_dir, "lineitem")

    def one_of(number, names):
        return F.element_at(F.array(*map(F.lit, names)), (number % 4 + 1).cast("int"))

    return lines.select(
        F.col("l_orderkey").alias("framework"), one_of(F.col("l_linenumber"), ("critical", "high", "medium", "low")).alias("severity"),
        one_of(F.col("l_partkey"), ("missing", "partial", "unclear", "met")).alias("status"), (F.col("l_linestatus") == "F").alias("supported"),
    )
