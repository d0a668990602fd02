"""Spans of what really ran: queries that are recorded as they are written, and triggers of streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lodestone.functions.text import failure_kind
from lodestone.session import written

SPAN = "run_id string, name string, kind string, started_ms long, duration_ms long, model string, input_tokens long, output_tokens long, cached boolean, n_rows long, message string"
#: Columns of a recorded table whose sums are the tokens of its span.
TOKENS = ("input_tokens", "output_tokens")


def _observed(df: DataFrame) -> list:
    sums = [F.sum(c).cast("long").alias(c) for c in TOKENS if c in df.columns]
    return [F.count(F.lit(1)).alias("n_rows"), *sums]


class Trace:
    """The spans of one run."""

    def __init__(self, spark: SparkSession, run_id: str):
        self.spark, self.run_id, self._spans = spark, run_id, []

    def record(self, name: str, kind: str, make: Callable[[], DataFrame], model: str | None = None, cached: bool = False) -> DataFrame:
        """make()'s table, computed once, with a span of its time, its rows and the sums of its columns input_tokens and output_tokens.

        The numbers are observed while the table is written, not counted again. A failure is
        recorded with its message and raised.
        """
        started, watch = time.time(), Observation()
        try:
            table = make()
            kept = written(table.observe(watch, *_observed(table)), name)
        except Exception as failure:
            self.add(name, kind, started, model, cached, {}, str(failure))
            raise
        self.add(name, kind, started, model, cached, watch.get)
        return kept

    def add(self, name: str, kind: str, started: float, model: str | None, cached: bool, seen: dict, message: str | None = None) -> None:
        """A span that has ended just now."""
        tokens = [seen.get(c) for c in TOKENS]
        self._spans.append((self.run_id, name, kind, int(started * 1000), int((time.time() - started) * 1000), model, *tokens, cached, seen.get("n_rows"), message))

    def spans(self) -> DataFrame:
        """The spans so far, as trace_costs() takes them; of a failure its kind is told and not what was said."""
        spans = self.spark.createDataFrame(self._spans, SPAN)
        return spans.withColumn("error", F.when(F.col("message").isNotNull(), failure_kind(F.col("message")))).drop("message")


class StreamSpans(StreamingQueryListener):
    """A span for each trigger of the streams that run while it listens, named as the stream is.

        spark.streams.addListener(StreamSpans(trace, kind="generate", model=...))

    Tokens are those that the stream observes under the name tokens.
    """

    def __init__(self, trace: Trace, kind: str, model: str | None = None):
        self.trace, self.kind, self.model = trace, kind, model

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        seen = {"n_rows": progress.numInputRows, **{k: v for m in progress.observedMetrics.values() for k, v in m.asDict().items() if k in TOKENS}}
        began = time.time() - progress.durationMs.get("triggerExecution", 0) / 1000
        self.trace.add(progress.name or str(progress.id), self.kind, began, self.model, False, seen)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.trace.add(str(event.id), self.kind, time.time(), self.model, False, {}, event.exception)
