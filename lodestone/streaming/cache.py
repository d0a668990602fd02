"""The result cache before a stream of requests: answers that are known cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import trimmed
from lodestone.operators.reports import document_hash, newest_per_document


def by_cache(requests: DataFrame, reports: DataFrame, sample: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """requests (document and others) that a readable report answers, with report_id, and the others.

    requests may be a stream: reports are then a static side that each trigger reads anew, and the
    two results are streams. The sample document is never answered from the cache. What is left
    goes to the rate limit; a hit is not charged.
    """
    exempt = F.coalesce(trimmed(F.col("document")) == sample.strip(), F.lit(True))
    keyed = requests.withColumn("document_hash", F.when(~exempt, document_hash(F.col("document"))))
    known = newest_per_document(reports, now).select("document_hash", "report_id")
    return keyed.join(known, "document_hash").drop("document_hash"), keyed.join(known, "document_hash", "left_anti").drop("document_hash")
