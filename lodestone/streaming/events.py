"""The event log of assessments as a stream: JSON lines in, JSON lines out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import failure_kind
from lodestone.session import written

# The fields of an event; a line holds those of its type.
EVENT = "type string, document_id string, seq int, framework string, score long, message string, at timestamp"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from JSON lines files; lines that are no JSON object are skipped."""
    lines = spark.readStream.text(path)
    return parsed_events(lines)


def parsed_events(lines: DataFrame) -> DataFrame:
    """Events of lines (value); also for a batch."""
    return lines.select(F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e")).filter("e.type is not null").select("e.*")


def event_lines(events: DataFrame) -> DataFrame:
    """value: one JSON object for each event, null fields left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def write_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append events to path as JSON lines; the checkpoint makes each one appear once."""
    return event_lines(events).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def ordered_events(documents: DataFrame, assessed: DataFrame) -> DataFrame:
    """document_id, seq and the fields of an event for documents (document_id): start, then one for each row of
    assessed (document_id, framework, score) in order of framework, and done with the number of these."""
    listed = assessed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("framework", "score"))).alias("found"))
    both = documents.select("document_id").distinct().join(listed, "document_id", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<framework: string, score: long>>)")))

    def event(kind: str, framework: Column, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), framework.cast("string").alias("framework"), score.cast("long").alias("score"), F.lit(None).cast("string").alias("message"))

    none = F.lit(None)
    events = F.concat(F.array(event("start", none, none)), F.transform("found", lambda f: event("framework", f["framework"], f["score"])), F.array(event("done", none, F.size("found"))))
    return both.select("document_id", F.posexplode(events).alias("seq", "e")).select("document_id", "seq", "e.*")


def failed_events(documents: DataFrame, message: str) -> DataFrame:
    """The events of documents whose assessment failed: start, and an error of its kind as the last one."""
    kind = failure_kind(F.lit(message))
    error = F.struct(F.lit("error").alias("type"), F.lit(None).cast("string").alias("framework"), F.lit(None).cast("long").alias("score"), kind.alias("message"))
    start = F.struct(F.lit("start").alias("type"), F.lit(None).cast("string").alias("framework"), F.lit(None).cast("long").alias("score"), F.lit(None).cast("string").alias("message"))
    return documents.select("document_id").distinct().select("document_id", F.posexplode(F.array(start, error)).alias("seq", "e")).select("document_id", "seq", "e.*")


def assessed_stream(documents: DataFrame, assess: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Assess each trigger's documents and write their events, in order, to path/batch=n as JSON lines.

    documents: document_id and what assess needs, which gives document_id, framework, score. A
    trigger that is repeated after a crash replaces its own lines, so each event is there once.
    If assess fails, the trigger's documents end with an error and the stream goes on. once: stop
    when what is there now is done.
    """

    def batch(rows: DataFrame, number: int) -> None:
        try:
            events = written(ordered_events(rows, assess(rows)), "events")
        except Exception as failure:  # noqa: BLE001  whatever it is, the readers are told
            events = failed_events(rows, str(failure))
        ordered = events.repartition("document_id").sortWithinPartitions("document_id", "seq")
        event_lines(ordered).write.mode("overwrite").text(f"{path}/batch={number}")

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_stage(events: DataFrame) -> DataFrame:
    """The last event of each document, for a view of what goes on."""
    row = F.struct("at", "type", "framework", "score", "message")
    return events.groupBy("document_id").agg(F.max(row).alias("e")).select("document_id", "e.*")
