"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes all that the one before kept. The first four return the columns of documents,
the last the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language import UNDETERMINED, held_out, predict_language, train
from lodestone.llm.packing import pack
from lodestone.llm.pii import find_personal_data, masked
from lodestone.llm.queries import vocabulary
from lodestone.llm.simhash import simhash_groups

#: The stages are not SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def _row(docs: DataFrame) -> DataFrame:
    """docs as one column row, beside id and text: an operator's columns can't meet those of docs."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))


def _columns(docs: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters (null ones too); a missing lang becomes the predicted one."""
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    # where no language was learned, every row is undetermined
    lettered = F.col("lang_pred") != UNDETERMINED if model.languages else F.col("text").rlike(r"\p{L}")
    told = predict_language(_row(docs), model).filter(lettered)
    return told.select(*_columns(docs, lang=F.coalesce(F.col("row")["lang"], F.col("lang_pred"))))


def _without(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """rows but for those whose keys are in dropped. A merge join at every size: what is dropped grows with rows."""
    gone = dropped.select(*[F.col(k).alias(f"dropped_{k}") for k in keys]).distinct().hint("merge")
    same = [F.col(k).eqNullSafe(F.col(f"dropped_{k}")) for k in keys]
    return rows.join(gone, same, "left_anti")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id.

    A row goes by its id and its text, so another text under the same id stays. Rows that repeat
    both are one document, there as often as before.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = _row(docs).withColumn("text_sha256", F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256))
    dropped = exact_dedup(docs.select("doc_id", "text")).filter("not kept")
    return _without(rows, dropped, ["doc_id", "text_sha256"]).select(*_columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Rows of the same id are one document."""
    dropped = simhash_groups(docs.select("doc_id", "text")).filter("doc_id <> component_id or (doc_id is null and component_id is not null)")
    return _without(_row(docs), dropped, ["doc_id"]).select(*_columns(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets."""
    found = find_personal_data(_row(docs).select("row", "text"))
    hidden = found.select("row", masked(F.col("text"), F.col("spans")).alias("hidden"))
    return hidden.select(*_columns(docs, text=F.col("hidden"), n_chars=F.char_length("hidden").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents table in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
