"""Rate limits and costs of calls."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import rounded
from lodestone.session import written

# Visitor limit, visitor window in ms and daily limit of each bucket.
BUCKETS = {
    "assess": (3, 3_600_000, 100),
    "search": (40, 3_600_000, 2000),
    "extract": (30, 3_600_000, 1000),
    "rerank": (10, 3_600_000, 300),
}
DAY_MS = 86_400_000
#: The slices of time that calls are counted by.
SLICE_MS = 60_000
# US dollars for a million tokens, in and out.
PRICES = {"gemini-3.6-flash": (0.3, 2.5), "gemini-embedding-001": (0.15, 0.0)}


def widened(limit: int, daily: int) -> tuple[int, int]:
    """Limits outside production."""
    return max(limit, 50), max(daily, 500)


def fixed_windows(calls: DataFrame, limit: int, window_ms: int, daily: int) -> DataFrame:
    """calls (call_id, bucket, visitor, at_ms) with n_window, n_day and allowed.

    Windows are cut from the epoch. A refused call is charged to both counters, so a call is
    allowed exactly if its number in its window and its number in the day are within limits.
    """
    own = Window.partitionBy("bucket", "visitor", F.floor(F.col("at_ms") / window_ms)).orderBy("at_ms", "call_id")
    # the numbers of a day: running counts by minute first, then inside the minute
    minute = calls.withColumn("_minute", F.floor(F.col("at_ms") / 60_000)).withColumn("_day", F.floor(F.col("at_ms") / DAY_MS))
    counts = minute.groupBy("bucket", "_day", "_minute").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("bucket", "_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    skipped = counts.select("bucket", "_minute", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("bucket", "_minute").orderBy("at_ms", "call_id")
    numbered = minute.join(skipped, ["bucket", "_minute"]).select(
        *calls.columns, F.row_number().over(own).cast("long").alias("n_window"), (F.col("_skip") + F.row_number().over(inside)).alias("n_day")
    )
    return numbered.withColumn("allowed", (F.col("n_window") <= limit) & (F.col("n_day") <= daily))


def _anchored(limit: int, window_ms: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, opened = None, 0, 0  # of the visitor at hand; it goes on from frame to frame
        for frame in frames:
            allowed, remaining = [], []
            for bucket, visitor, at in zip(frame["bucket"], frame["visitor"], frame["at_ms"], strict=True):
                if (bucket, visitor) != key or at - opened > window_ms:
                    key, count, opened, ok = (bucket, visitor), 1, at, True
                else:
                    ok = count < limit
                    count += ok
                allowed.append(ok)
                remaining.append(limit - count if ok else 0)
            yield frame.assign(allowed=allowed, remaining=remaining)

    return run


def anchored_windows(calls: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """call_id, bucket, visitor, at_ms, allowed, remaining of each call.

    A visitor's window opens at its first allowed call and again at a call that is more than
    window_ms later. Refused calls are not charged. The calls of a visitor pass in order through
    one task that keeps two numbers, so nothing is gathered by visitor. anchored_ceiling() knows
    the ceiling over all visitors as well.
    """
    ordered = calls.select("call_id", "bucket", "visitor", "at_ms").repartition("bucket", "visitor").sortWithinPartitions("bucket", "visitor", "at_ms", "call_id")
    return ordered.mapInPandas(_anchored(limit, window_ms), _decided(calls))


def _decided(calls: DataFrame) -> str:
    kinds = dict(calls.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("call_id", "bucket", "visitor", "at_ms")) + ", allowed boolean, remaining int"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a bucket in order (bucket, slice, times) to the start of the day that is open before the slice, and of one that begins in it."""
    bucket, opened = None, None
    for batch in batches:
        before, begun = [], []
        for own, times in zip(batch.column("bucket").to_pylist(), batch.column("times").to_pylist(), strict=True):
            if own != bucket:
                bucket, opened = own, None
            before.append(opened)
            at = 0 if opened is None else bisect_right(times, opened + DAY_MS)
            begun.append(times[at] if at < len(times) else None)
            opened = opened if begun[-1] is None else begun[-1]
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("slice"), pa.array(before, pa.int64()), pa.array(begun, pa.int64())], names=["bucket", "slice", "before", "begun"])


def anchored_days(calls: DataFrame) -> DataFrame:
    """calls (bucket, at_ms and others) with slice (a minute) and day_ms: the start of the 24 hours that the call belongs to.

    A bucket's day opens at its first call and again at the first call more than a day later. The
    distinct times of each minute, 60,000 at most, are walked in order, a minute at a time, so what a
    task reads of a bucket is bounded by the time that passes and not by its calls.
    """
    sliced = calls.withColumn("slice", F.floor(F.col("at_ms") / SLICE_MS))
    times = sliced.groupBy("bucket", "slice").agg(F.sort_array(F.collect_set("at_ms")).alias("times"))
    kind = dict(times.dtypes)["bucket"]
    ordered = times.repartition("bucket").sortWithinPartitions("bucket", "slice").select("bucket", "slice", "times")
    days = ordered.mapInArrow(_walked, f"bucket {kind}, slice long, before long, begun long")
    return sliced.join(days, ["bucket", "slice"]).withColumn("day_ms", F.when(F.col("at_ms") >= F.col("begun"), F.col("begun")).otherwise(F.col("before"))).drop("before", "begun")


def _anchored_below(limit: int, window_ms: int):
    """As _anchored, where calls that are over a ceiling are refused and change nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, opened = None, 0, 0
        for frame in frames:
            allowed, remaining = [], []
            for bucket, visitor, at, over in zip(frame["bucket"], frame["visitor"], frame["at_ms"], frame["over"], strict=True):
                if (bucket, visitor) != key:
                    key, count, opened = (bucket, visitor), 0, at
                if over:
                    ok = False
                elif count == 0 or at - opened > window_ms:
                    count, opened, ok = 1, at, True
                else:
                    ok = count < limit
                    count += ok
                allowed.append(ok)
                remaining.append(limit - count if ok else 0)
            yield frame.drop(columns="over").assign(allowed=allowed, remaining=remaining)

    return run


def _cuts(decided: DataFrame, daily: int) -> DataFrame:
    """bucket, day_ms, cut_ms, cut_id: the allowed call that fills each day; running counts by slice find its slice first."""
    counts = decided.filter("allowed").groupBy("bucket", "day_ms", "slice").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("bucket", "day_ms").orderBy("slice"))
    full = counts.withColumn("skip", running - F.col("n")).filter((F.col("skip") < daily) & (F.col("skip") + F.col("n") >= daily)).drop("n")
    inside = Window.partitionBy("bucket", "day_ms", "slice").orderBy("at_ms", "call_id")
    last = decided.filter("allowed").join(full, ["bucket", "day_ms", "slice"]).withColumn("number", F.col("skip") + F.row_number().over(inside))
    return last.filter(F.col("number") == daily).select("bucket", "day_ms", F.col("at_ms").alias("cut_ms"), F.col("call_id").alias("cut_id"))


def anchored_ceiling(calls: DataFrame, limit: int, window_ms: int, daily: int) -> DataFrame:
    """As anchored_windows, with at most daily allowed calls of a bucket in a window of 24 hours that opens at its
    first call and again at a call that is more than a day later. Calls over the ceiling open no visitor's window.

    Which call fills a day depends on what visitors were allowed before, and this on the days
    before. So visitors are decided one by one, the call that fills each day is found by
    running counts, and both again until the filling calls stay the same: the first day is right after
    one round, the next after two at most, and a change reaches another day only through
    visitors whose windows go over its start.
    """
    if daily < 1:
        return anchored_windows(calls, limit, window_ms).withColumns({"allowed": F.lit(False), "remaining": F.lit(0)})
    kinds = dict(calls.dtypes)
    placed = written(anchored_days(calls.select("call_id", "bucket", "visitor", "at_ms")), "placed-calls")
    cuts = calls.sparkSession.createDataFrame([], f"bucket {kinds['bucket']}, day_ms long, cut_ms long, cut_id {kinds['call_id']}")
    while True:
        later = (F.col("at_ms") > F.col("cut_ms")) | ((F.col("at_ms") == F.col("cut_ms")) & (F.col("call_id") > F.col("cut_id")))
        known = placed.join(cuts, ["bucket", "day_ms"], "left").withColumn("over", F.coalesce(later, F.lit(False)))
        ordered = known.select("call_id", "bucket", "visitor", "at_ms", "slice", "day_ms", "over").repartition("bucket", "visitor").sortWithinPartitions("bucket", "visitor", "at_ms", "call_id")
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("call_id", "bucket", "visitor", "at_ms")) + ", slice long, day_ms long, allowed boolean, remaining int"
        decided = written(ordered.mapInPandas(_anchored_below(limit, window_ms), schema), "decided-calls")
        found = written(_cuts(decided, daily), "cuts")
        if found.exceptAll(cuts).isEmpty() and cuts.exceptAll(found).isEmpty():
            return decided.drop("slice", "day_ms")
        cuts = found


def trace_costs(spans: DataFrame, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """run_id, input_tokens, output_tokens, cost, n_cached, n_unpriced of each run.

    spans: run_id, kind, model, input_tokens, output_tokens, cached. Embeddings report no usage:
    those not cached are counted as unpriced and are left out of tokens and cost. The cost of a
    run is null if a span with tokens has no known rate, or if a generation or rerank that wasn't
    cached has no tokens.
    """
    rate_in = rate_out = F.lit(None).cast("double")
    for model, (into, out) in prices.items():
        rate_in = F.when(F.col("model") == model, F.lit(into)).otherwise(rate_in)
        rate_out = F.when(F.col("model") == model, F.lit(out)).otherwise(rate_out)
    embed = F.col("kind") == "embed"
    known = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    cost = (F.coalesce("input_tokens", F.lit(0)) * rate_in + F.coalesce("output_tokens", F.lit(0)) * rate_out) / 1e6
    open_ = ~embed & F.when(known, rate_in.isNull()).otherwise(F.col("kind").isin("generate", "rerank") & ~F.col("cached"))
    return spans.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(~embed, F.col("input_tokens"))), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.sum(F.when(~embed, F.col("output_tokens"))), F.lit(0)).cast("long").alias("output_tokens"),
        F.when(F.count_if(open_) > 0, F.lit(None)).otherwise(rounded(F.coalesce(F.sum(F.when(~embed & known, cost)), F.lit(0.0)))).alias("cost"),
        F.count_if("cached").alias("n_cached"),
        F.count_if(embed & ~F.col("cached")).alias("n_unpriced"),
    )
