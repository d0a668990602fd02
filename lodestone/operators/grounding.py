"""Verification of quotes against the passages they were taken from, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import folded, quote_tokens, rounded

NEAR, LEAST_TOKENS = 0.75, 4
# Points taken off for a finding, by severity, and the share of them by status.
SEVERITY = {"critical": 30, "high": 18, "medium": 9, "low": 4}
STATUS = {"missing": 1.0, "partial": 0.5, "unclear": 0.25, "met": 0.0}


def window_overlap(quote: list[str], source: list[str]) -> float:
    """The greatest share of quote's tokens, as a bag, in any window of source as long as it."""
    from collections import Counter

    if not len(quote) or not len(source):
        return 0.0
    need, have, matched, best = Counter(quote), Counter(), 0, 0
    for k, token in enumerate(source):
        have[token] += 1
        matched += have[token] <= need[token]
        if k >= len(quote):
            gone = source[k - len(quote)]
            matched -= have[gone] <= need[gone]
            have[gone] -= 1
        best = max(best, matched)
    return best / len(quote)


def _overlaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["similarity"] = [window_overlap(list(q), list(s)) for q, s in zip(frame.pop("_quote"), frame.pop("_source"), strict=True)]
        yield frame


def verify_quotes(pairs: DataFrame) -> DataFrame:
    """claim_id, verdict, similarity, offset of each claim; pairs: claim_id, quote, source (one row each).

    Quotes under four tokens are unsupported even when verbatim. exact if a source holds the
    folded quote (offset in the first such source by source_no if there is that column), else near
    at an overlap of 0.75 in some window, else unsupported. Only pairs that are not exact go to
    the window kernel. A claim whose sources are all null is unsupported with similarity 0.
    """
    number = F.col("source_no") if "source_no" in pairs.columns else F.lit(0)
    quote, source = folded(F.col("quote")), folded(F.col("source"))
    told = pairs.select("claim_id", number.alias("no"), quote.alias("q"), source.alias("s"), quote_tokens(F.col("quote")).alias("_quote"), quote_tokens(F.col("source")).alias("_source"))
    told = told.select("claim_id", "no", (F.size("_quote") >= LEAST_TOKENS).alias("long"), F.expr("instr(s, q)").alias("at"), "_quote", "_source")
    exact = told.filter("long and at > 0").select("claim_id", F.struct("no", (F.col("at") - 1).cast("long").alias("offset")).alias("hit"), F.lit(1.0).alias("similarity"))
    rest = told.filter("long and not coalesce(at > 0, false)").select("claim_id", F.coalesce("_quote", F.array().cast("array<string>")).alias("_quote"), F.coalesce("_source", F.array().cast("array<string>")).alias("_source"))
    near = rest.mapInPandas(_overlaps, f"claim_id {dict(pairs.dtypes)['claim_id']}, similarity double")
    none = F.lit(None).cast("struct<no:int,offset:bigint>")
    every = (
        exact.select("claim_id", F.struct(F.col("hit.no").cast("int").alias("no"), F.col("hit.offset").alias("offset")).alias("hit"), "similarity")
        .union(near.select("claim_id", none, "similarity"))
        .union(told.filter("not coalesce(long, false)").select("claim_id", none, F.lit(0.0)))
    )
    best = every.groupBy("claim_id").agg(F.min("hit").alias("hit"), rounded(F.max("similarity")).alias("similarity"))
    verdict = F.when(F.col("hit").isNotNull(), "exact").when(F.col("similarity") >= NEAR, "near").otherwise("unsupported")
    return best.select("claim_id", verdict.alias("verdict"), "similarity", F.col("hit.offset").alias("offset"))


def grounding_totals(verdicts: DataFrame) -> DataFrame:
    """One row: exact, near, unsupported, total, rate. The rate of no claims is 1."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("exact", "near", "unsupported")]
    found = verdicts.agg(*counts, F.count("*").alias("total"))
    return found.withColumn("rate", F.when(F.col("total") == 0, 1.0).otherwise(rounded((F.col("exact") + F.col("near")) / F.col("total"))))


def _points(table: dict[str, float], name: Column) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(name == key, F.lit(float(value)))
    return out.otherwise(0.0)


def framework_scores(findings: DataFrame) -> DataFrame:
    """framework, n_findings, n_supported, score from findings (framework, severity, status, supported).

    100 less the points of supported findings, halves up, at least 0; 100 without any.
    """
    taken = F.when(F.col("supported"), _points(SEVERITY, F.col("severity")) * _points(STATUS, F.col("status"))).otherwise(0.0)
    grouped = findings.groupBy("framework").agg(
        F.count("*").alias("n_findings"), F.count_if("supported").alias("n_supported"), F.sum(taken).alias("taken")
    )
    return grouped.select("framework", "n_findings", "n_supported", F.greatest(F.lit(0), F.floor(100 - F.col("taken") + 0.5)).cast("long").alias("score"))


def uncited(findings: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Findings whose (framework, citation) was not among what was retrieved."""
    return findings.join(retrieved.select("framework", "citation").distinct(), ["framework", "citation"], "left_anti")
