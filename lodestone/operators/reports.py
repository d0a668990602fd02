"""Saved reports: cache lookup, expiry, upsert, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import trimmed

KEPT_DAYS = 30
ID = "^[A-Za-z0-9_-]{8,24}$"


def document_hash(text: Column) -> Column:
    """The key of the cache: sha256 of the trimmed document alone."""
    return F.sha2(trimmed(text), 256)


def loadable(reports: DataFrame, now: Column) -> DataFrame:
    """Reports that can be read at now. A pinned one past its time can't, though it is kept."""
    return reports.filter(F.col("expires_at") > now)


def purged(reports: DataFrame, now: Column) -> DataFrame:
    """What a purge leaves: reports that are pinned or not past their time."""
    return reports.filter((F.col("expires_at") >= now) | F.col("pinned"))


def purge_count(reports: DataFrame, now: Column) -> DataFrame:
    return reports.agg(F.count_if((F.col("expires_at") < now) & ~F.col("pinned")).alias("n_purged"))


def newest_per_document(reports: DataFrame, now: Column) -> DataFrame:
    """document_hash, report_id, created_at of the newest readable report of each document; of
    equal times the greatest id. An aggregate, so a document with very many reports combines early."""
    best = F.max(F.struct("created_at", "report_id")).alias("best")
    return loadable(reports, now).groupBy("document_hash").agg(best).select("document_hash", "best.report_id", "best.created_at")


def cached_answers(requests: DataFrame, reports: DataFrame, sample: str, now: Column) -> DataFrame:
    """request_id, report_id of requests (request_id, document) that a readable report answers; the sample document is exempt."""
    asked = requests.filter(trimmed(F.col("document")) != sample.strip()).select("request_id", document_hash(F.col("document")).alias("document_hash"))
    return asked.join(newest_per_document(reports, now), "document_hash").select("request_id", "report_id")


def by_id(reports: DataFrame, report_id: str, now: Column) -> DataFrame:
    """The readable report of an id; an id of another shape is not looked up."""
    import re

    return loadable(reports, now).filter(F.lit(bool(re.match(ID, report_id))) & (F.col("report_id") == report_id))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], at: str | None = None) -> DataFrame:
    """old with the rows of new: those of a known key replace the given columns, others are added.

    If new has a key more than once, the row with the greatest at counts, the one written last; without at,
    rows have no order, and the greatest row (by the columns in order) counts. at itself isn't kept.
    """
    rest = [c for c in old.columns if c != key]
    ordered = F.struct(*columns, *[c for c in rest if c not in columns])
    last = new.groupBy(key).agg((F.max_by(ordered, F.struct(at, ordered)) if at else F.max(ordered)).alias("n"))
    known, fresh = F.col("l.n").isNotNull(), F.col("_old").isNull()
    marked = old.withColumn("_old", F.lit(True)).alias("o").join(last.alias("l"), key, "full_outer")
    return marked.select(
        key, *[F.when(known & (F.lit(c in columns) | fresh), F.col(f"l.n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    )


def days_left(expires_at: Column, now: Column) -> Column:
    left = (F.unix_micros(expires_at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400_000_000
    return F.greatest(F.lit(0), F.ceil(left)).cast("long")


def score_tone(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 60, "fair").otherwise("poor")


def saved(reports: DataFrame, new: DataFrame, now: Column, days: int = KEPT_DAYS) -> tuple[DataFrame, DataFrame]:
    """The reports with new ones (report_id, document and columns of reports) and without those past their time, and
    report_id, expires_at of the new ones. A column of reports that new lacks is null."""
    made = {"document_hash": document_hash(F.col("document")), "created_at": now, "expires_at": now + F.expr(f"interval {days} days"), "pinned": F.lit(False)}
    kinds = dict(reports.dtypes)
    rows = new.select([(made[c] if c in made else F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in reports.columns])
    return purged(reports.unionByName(rows), now), rows.select("report_id", "expires_at")


def group_counts(rows: DataFrame, group: str) -> DataFrame:
    """group, n of each, and n of all under null: what was pushed."""
    return rows.rollup(group).agg(F.count("*").alias("n"))


def _share(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def to_markdown(heads: DataFrame, frameworks: DataFrame, findings: DataFrame) -> DataFrame:
    """report_id, markdown of whole reports.

    heads: report_id, summary, assessed_at (text or null), n_sections, n_chunks, dimensions, model,
    seconds, input_tokens, output_tokens, cost (null if unknown). frameworks: report_id, place,
    framework, score, confidence, rationale, has_corpus, n_passages. findings: report_id,
    framework, place, requirement, severity, status, supported, explanation, document_quote,
    document_verdict, regulation_quote, citation, verdict. The verdicts go along with the findings.
    """
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    quoted = F.when(~blank("document_quote"), text("\n\n> ", F.col("document_quote"), "\n> — the document (", F.coalesce("document_verdict", F.lit("not checked")), ")")).otherwise("")
    one = text(
        "### ", F.col("requirement"), "\n\n**", F.col("severity"), " · ", F.col("status"), "** · quote ", F.col("verdict"),
        F.when(F.col("supported"), "").otherwise(" — unsupported, not in the score"), "\n\n", F.col("explanation"), quoted,
        "\n\n> ", F.col("regulation_quote"), "\n> — ", F.col("citation"), " (", F.col("verdict"), ")",
    )
    listed = findings.groupBy("report_id", "framework").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("said")))).alias("all"))
    listed = listed.select("report_id", "framework", F.array_join(F.transform("all", lambda f: f["said"]), "\n\n").alias("said"))
    body = (
        F.when(~F.col("has_corpus"), "> There is no text of it to cite, so it has no findings and no score.")
        .when(F.col("said").isNull(), text("No findings in the ", F.col("n_passages").cast("string"), " passages found."))
        .otherwise(F.col("said"))
    )
    head = text("## ", F.col("framework"), F.when(F.col("score").isNotNull(), text(" — ", F.col("score").cast("string"), "/100")).otherwise(""), "\n\n_Confidence ", _share(F.col("confidence")), "._ ", F.col("rationale"))
    parts = frameworks.join(listed, ["report_id", "framework"], "left").select("report_id", "place", text(head, "\n\n", body).alias("said"))
    parts = parts.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("all"))
    parts = parts.select("report_id", F.array_join(F.transform("all", lambda f: f["said"]), "\n\n").alias("frameworks"))
    totals = findings.groupBy("report_id").agg(F.count("*").alias("n"), F.count_if("supported").alias("n_supported"))
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("n_supported", F.lit(0))
    grounding = F.when(n == 0, "There were no findings to verify.").otherwise(text(
        good.cast("string"), " of ", n.cast("string"), " findings quote text that stands in the passages (", _share(good / n), ").",
        F.when(good < n, text("\n\n", (n - good).cast("string"), " quote text that was not found; they are marked and count for no score.")).otherwise(""),
    ))
    corpus = text("- **Corpus:** ", F.col("n_sections").cast("string"), " sections, ", F.col("n_chunks").cast("string"), " passages, ", F.col("dimensions").cast("string"), "d `", F.col("model"), "`")
    made = text(F.format_string("%.1fs, %,d input and %,d output tokens", F.col("seconds").cast("double"), F.col("input_tokens").cast("long"), F.col("output_tokens").cast("long")), F.when(F.col("cost").isNull(), ".").otherwise(F.format_string(", about $%.4f.", F.col("cost").cast("double"))))
    whole = text(
        "# Assessment\n\n", F.when(F.col("assessed_at").isNull(), "").otherwise(text("- **Assessed:** ", F.col("assessed_at"), "\n")), corpus,
        "\n\n## What was read\n\n", F.col("summary"), "\n\n## Grounding\n\n", grounding, "\n\n", F.coalesce("frameworks", F.lit("")), "\n\n## How it was made\n\n", made, "\n",
    )
    return heads.join(parts, "report_id", "left").join(totals, "report_id", "left").select("report_id", whole.alias("markdown"))
