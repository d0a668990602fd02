"""What became of model calls and findings: failures, constraints, attacks, passages for prompts, health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import FAILURE_RULES

# The HTTP status of each kind of failure and whether the same thing may be tried again.
FAILURES = {
    "model-budget": (503, False),
    "model-busy": (503, True),
    "model-auth": (503, False),
    "model-timeout": (504, True),
    "unknown": (500, True),
}
_SAID = {
    "model-budget": "The budget for model calls is spent. What was assessed before can still be read.",
    "model-busy": "The model takes no more requests at the moment. Try again in a minute.",
    "model-auth": "The model can't be reached.",
    "model-timeout": "The model took too long. Try again.",
    "unknown": "Something failed on our side. Try again.",
}
# What findings may say.
STATUSES, SEVERITIES, MOST_FINDINGS = ("met", "partial", "missing", "unclear"), ("critical", "high", "medium", "low"), 12
# Least characters of the texts of a finding.
LEAST_CHARS = {"requirement": 8, "explanation": 20, "regulation_quote": 10, "citation": 3}
#: Characters of a passage that a judge is shown.
RERANK_CHARS = 700
# How a severity is shown.
TONES = {"critical": "unsupported", "high": "unsupported", "medium": "near", "low": "neutral"}


def public_failures(failures: DataFrame) -> DataFrame:
    """failures (kind and others) with message, status, retryable of the kind; a kind that isn't known counts as unknown."""
    known = [k for k, _ in FAILURE_RULES]
    kind = F.when(F.col("kind").isin(*known), F.col("kind")).otherwise("unknown")
    table = failures.sparkSession.createDataFrame([(k, _SAID[k], *v) for k, v in FAILURES.items()], "kind string, message string, status int, retryable boolean")
    return failures.withColumn("kind", kind).join(F.broadcast(table), "kind")  # five rows


def severity_tone(severity: Column) -> Column:
    out = F
    for name, tone in TONES.items():
        out = out.when(severity == name, tone)
    return out.otherwise(None)


def violations(findings: DataFrame) -> DataFrame:
    """findings with violations: the names of the rules that a row breaks, in alphabetical order.

    findings: case_id, position (from 0) and requirement, status, severity, explanation,
    regulation_quote, citation. Beyond twelve findings a case's further ones break "number".
    """
    rules = {name: F.coalesce(F.char_length(name) >= least, F.lit(False)) for name, least in LEAST_CHARS.items()}
    rules |= {name: F.coalesce(F.col(name).isin(*allowed), F.lit(False)) for name, allowed in (("status", STATUSES), ("severity", SEVERITIES))}
    rules["number"] = F.col("position") < MOST_FINDINGS
    return findings.withColumn("violations", F.array_compact(F.array(*[F.when(~ok, name) for name, ok in sorted(rules.items())])))


def quarantined(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """findings that break no rule, and those that do."""
    judged = violations(findings)
    return judged.filter(F.size("violations") == 0).drop("violations"), judged.filter(F.size("violations") > 0)


def first_issues(findings: DataFrame, most: int = 6) -> DataFrame:
    """case_id, issues: the first ones of each case, as position:rule."""
    listed = violations(findings).select("case_id", "position", F.explode("violations").alias("rule"))
    return listed.groupBy("case_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("position", "rule"))), 1, most).alias("first")).select(
        "case_id", F.array_join(F.transform("first", lambda i: F.concat_ws(":", i["position"].cast("string"), i["rule"])), ",").alias("issues")
    )


def answer_counters(answers: DataFrame) -> DataFrame:
    """One row: n_calls, n_valid, n_repaired, n_failed. answers: attempts (calls made), valid (whether the last one passed)."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    return answers.agg(
        F.count("*").alias("n_calls"), F.count_if(valid & (F.col("attempts") <= 1)).alias("n_valid"), F.count_if(valid & (F.col("attempts") > 1)).alias("n_repaired"), F.count_if(~valid).alias("n_failed")
    )


def attack_tallies(findings: DataFrame, retrieved: DataFrame, markers: dict[str, str]) -> DataFrame:
    """What came of planted instructions: one row for each case_id.

    findings: case_id, framework, citation, text (all that the model wrote), verdict, supported;
    retrieved: case_id, framework, citation; markers: a name and a pattern for each sign that an
    instruction was obeyed. caught: quotes that could not be verified; missed: those of them that count
    as supported all the same; not_retrieved: citations that were not among the passages shown.
    """
    shown = retrieved.select("case_id", "framework", "citation").distinct().withColumn("shown", F.lit(True))
    both = findings.join(shown, ["case_id", "framework", "citation"], "left")
    signs = F.array_compact(F.array(*[F.when(F.col("text").rlike(pattern), name) for name, pattern in sorted(markers.items())]))
    unverified = F.col("verdict") == "unsupported"
    told = both.groupBy("case_id").agg(
        F.count("*").alias("n_findings"), F.count_if("supported").alias("n_supported"), F.count_if(~F.col("supported")).alias("n_unsupported"),
        F.count_if(unverified).alias("caught"), F.count_if(unverified & F.col("supported")).alias("missed"),
        F.count_if(F.col("shown").isNull()).alias("not_retrieved"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(signs)))).alias("obeyed"),
    )
    return told.withColumn("obeyed", F.array_join("obeyed", ","))


def passage_blocks(found: DataFrame) -> DataFrame:
    """query_id, block: the passages of a query as a prompt shows them, numbered by rank; found: query_id, rank, citation, heading, text."""
    one = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("citation"), F.lit(" — "), F.col("heading"), F.lit("\n"), F.col("text"))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("said")))).alias("all"))
    return listed.select("query_id", F.array_join(F.transform("all", lambda p: p["said"]), "\n\n").alias("block"))


def rerank_prompts(found: DataFrame) -> DataFrame:
    """query_id, prompt of the judge: the question, and each passage by its position, cut at RERANK_CHARS; found: query_id, query, position, heading, text."""
    one = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("heading"), F.lit("\n"), F.substring("text", 1, RERANK_CHARS))
    listed = found.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("said")))).alias("all"))
    asked = F.concat(F.lit("Answer with a relevance of 0 to 3 for each of the "), F.size("all").cast("string"), F.lit(" passages."))
    return listed.select("query_id", F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("query")), F.array_join(F.transform("all", lambda p: p["said"]), "\n\n"), asked).alias("prompt"))


def parsed_blocks(blocks: DataFrame) -> DataFrame:
    """query_id, rank, citation, heading, text of the passages in blocks (query_id, block); the inverse of passage_blocks
    for texts without a line that looks like the head of a passage."""
    head = r"\[([0-9]+)\] (.+?) — (.+?)\n"
    parts = F.split("block", r"\n\n(?=\[[0-9]+\] .+? — )")
    rows = blocks.select("query_id", F.explode(parts).alias("part")).filter(F.col("part").rlike("^" + head))
    fields = [F.regexp_extract("part", "^" + head, k) for k in (1, 2, 3)]
    return rows.select("query_id", fields[0].cast("long").alias("rank"), fields[1].alias("citation"), fields[2].alias("heading"), F.regexp_replace("part", "^" + head, "").alias("text"))


def health(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """check, ok, detail: that there are chunks, that ids are unique, and that vectors have one size and a chunk each."""
    counted = chunks.agg(F.count("*").alias("n"), F.countDistinct("chunk_idx").alias("m"), F.countDistinct("citation").alias("c"))
    sizes = vectors.agg(F.countDistinct(F.size("embedding")).alias("n"), F.max(F.size("embedding")).alias("d"))
    alone = vectors.join(chunks.select("chunk_idx"), "chunk_idx", "left_anti").agg(F.count("*").alias("n"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    n, d = F.col("n").cast("string"), F.col("d").cast("string")
    return (
        counted.select(F.lit("index").alias("check"), (F.col("n") > 0).alias("ok"), text(n, " chunks from ", F.col("c").cast("string"), " sections").alias("detail"))
        .union(counted.select(F.lit("ids"), F.col("n") == F.col("m"), text((F.col("n") - F.col("m")).cast("string"), " repeated")))
        .union(sizes.select(F.lit("dimensions"), F.col("n") == 1, text(d, "d")))
        .union(alone.select(F.lit("vectors"), F.col("n") == 0, text(n, " without a chunk")))
    )


def paired_spans(events: DataFrame) -> DataFrame:
    """run_id, name, started_ms, duration_ms, failed of each span. events: run_id, name, phase (start, end or error), at_ms.

    A span is a run's events of one name; one that has only begun has no duration.
    """
    at = lambda *phases: F.min(F.when(F.col("phase").isin(*phases), F.col("at_ms")))
    both = events.groupBy("run_id", "name").agg(at("start").alias("started_ms"), at("end", "error").alias("ended"), (F.count_if(F.col("phase") == "error") > 0).alias("failed"))
    return both.filter("started_ms is not null").select("run_id", "name", "started_ms", (F.col("ended") - F.col("started_ms")).alias("duration_ms"), "failed")


def in_classifier_order(assessments: DataFrame, classified: DataFrame) -> DataFrame:
    """assessments (document_id, framework and others) with place: where the classifier named the framework, from 1."""
    return assessments.join(classified.select("document_id", "framework", F.col("position").alias("place")), ["document_id", "framework"], "left")


def corpus_backed(frameworks: DataFrame, chunks: DataFrame) -> DataFrame:
    """frameworks with has_corpus: whether there is any text to cite. Those without get no findings and no score."""
    known = chunks.select("framework").distinct().withColumn("_known", F.lit(True))
    return frameworks.join(known, "framework", "left").withColumn("has_corpus", F.coalesce("_known", F.lit(False))).drop("_known")


def shuffled(size: int, seed: int = 1) -> list[int]:
    """A permutation of range(size) that depends on seed alone: Fisher and Yates with the generator Mulberry32."""
    mask, state = 0xFFFFFFFF, seed & 0xFFFFFFFF
    order = list(range(size))
    for last in range(size - 1, 0, -1):
        state = (state + 0x6D2B79F5) & mask
        t = (state ^ state >> 15) * (state | 1) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        pick = int((t ^ t >> 14) / 4294967296 * (last + 1))
        order[last], order[pick] = order[pick], order[last]
    return order


def presented(found: DataFrame, seed: int = 1) -> DataFrame:
    """found (query_id, chunk_idx, rank: 1 to the number of the query's rows) with position: where a judge is shown each row, from 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            places = {n: {k: p for p, k in enumerate(shuffled(n, seed))} for n in set(frame["n"].tolist())}
            yield frame.assign(position=[places[n][r - 1] for n, r in zip(frame["n"], frame["rank"], strict=True)]).drop(columns="n")

    sizes = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return found.select("query_id", "chunk_idx", F.col("rank").cast("long").alias("rank")).join(sizes, "query_id").select("query_id", "chunk_idx", "rank", "n").mapInPandas(
        run, "query_id long, chunk_idx long, rank long, position long"
    )
