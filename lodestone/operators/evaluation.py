"""Retrieval metrics over rankings and gold labels.

rankings: config, query_id, citation, rank (from 1); queries: query_id, slice; gold: query_id,
citation (at least one for each query). Everything is one pass of grouped aggregates, for all
configurations and slices at once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fixed, percent, rounded

# The depths of recall, and the cutoff of the other metrics.
DEPTHS, CUTOFF = (1, 3, 5, 10), 10


def citation_ranking(rankings: DataFrame) -> DataFrame:
    """The first row of each citation, ranked anew without gaps."""
    first = rankings.groupBy("config", "query_id", "citation").agg(F.min("rank").alias("rank"))
    window = Window.partitionBy("config", "query_id").orderBy("rank")
    return first.withColumn("rank", F.row_number().over(window).cast("long"))


def query_metrics(rankings: DataFrame, gold: DataFrame, configs: Sequence[str] | None = None) -> DataFrame:
    """config, query_id, recall at each depth, mrr, ndcg; queries that a configuration missed count as 0.

    configs: the names, if they are known; otherwise the rankings are read once more for them.
    """
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    named = F.explode(F.array(*map(F.lit, configs))) if configs else None
    hits = citation_ranking(rankings).join(gold.distinct(), ["query_id", "citation"])
    near = F.col("rank") <= CUTOFF
    sums = hits.groupBy("config", "query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in DEPTHS],
        F.min(F.when(near, F.col("rank"))).alias("first"),
        F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(CUTOFF)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    wanted = sizes.withColumn("ideal", ideal)
    # the configurations are the few that were run
    every = wanted.withColumn("config", named) if configs else wanted.crossJoin(F.broadcast(rankings.select("config").distinct()))
    every = every.join(sums, ["config", "query_id"], "left")
    return every.select(
        "config",
        "query_id",
        *[(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}") for k in DEPTHS],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
    )


_METRICS = [*[f"recall_{k}" for k in DEPTHS], "mrr", "ndcg"]


def _means():
    return [rounded(F.avg(m)).alias(m) for m in _METRICS]


def metrics(per_query: DataFrame) -> DataFrame:
    """config, n, and the mean of each metric."""
    return per_query.groupBy("config").agg(F.count("*").alias("n"), *_means())


def metrics_by_slice(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """config, slice, n, means; the slice all holds every query."""
    named = per_query.join(queries.select("query_id", "slice"), "query_id")
    both = named.select("*", F.explode(F.array("slice", F.lit("all"))).alias("of")).drop("slice").withColumnRenamed("of", "slice")
    return both.groupBy("config", "slice").agg(F.count("*").alias("n"), *_means())


def recall_by_framework(per_query: DataFrame, queries: DataFrame, configs: list[str]) -> DataFrame:
    """framework, n and recall at the cutoff, one column for each configuration."""
    named = per_query.join(queries.select("query_id", "framework"), "query_id")
    cells = [rounded(F.avg(F.when(F.col("config") == c, F.col(f"recall_{CUTOFF}")))).alias(c) for c in configs]
    return named.groupBy("framework").agg(F.countDistinct("query_id").alias("n"), *cells)


def best_config(table: DataFrame, order: dict[str, int], metric: str = "ndcg") -> DataFrame:
    """The row with the greatest metric; of equals the first in order."""
    place = F
    for name, n in order.items():
        place = place.when(F.col("config") == name, F.lit(n))
    return table.orderBy(F.desc(metric), place.otherwise(len(order))).limit(1)


def missing_gold(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """Gold rows whose citation the corpus lacks; there must be none."""
    return gold.join(corpus.select("citation").distinct(), "citation", "left_anti")


def chosen_weight(per_query: DataFrame, queries: DataFrame, dev: str = "direct") -> DataFrame:
    """One row (weight, ndcg): the weight with the greatest mean nDCG on the dev slice; of equals the smallest.

    per_query: config (the weight as text), query_id, ndcg.
    """
    mine = per_query.join(queries.filter(F.col("slice") == dev).select("query_id"), "query_id")
    means = mine.groupBy(F.col("config").cast("double").alias("weight")).agg(rounded(F.avg("ndcg")).alias("ndcg"))
    return means.agg(F.max_by("weight", F.struct("ndcg", -F.col("weight"))).alias("weight"), F.max("ndcg").alias("ndcg"))


def gold_totals(gold: DataFrame, queries: DataFrame) -> DataFrame:
    """slice, n_queries, n_labels of the gold set, and the whole as all."""
    sizes = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    told = sizes.join(queries.select("query_id", "slice"), "query_id").select("n", F.explode(F.array("slice", F.lit("all"))).alias("slice"))
    return told.groupBy("slice").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_labels"))


def missing_slices(queries: DataFrame, wanted: Sequence[str] = ("direct", "paraphrased")) -> DataFrame:
    """slice of each wanted one that no query has; an evaluation with any fails."""
    names = queries.sparkSession.createDataFrame([(w,) for w in wanted], "slice string")
    return names.join(queries.select("slice").distinct(), "slice", "left_anti")


def recall_curve(means: DataFrame, configs: Sequence[str]) -> DataFrame:
    """k, and recall in percent to one place, one column for each configuration: the rows of a line chart."""
    long = means.select("config", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in DEPTHS])))
    return long.groupBy("k").agg(*[F.max(F.when(F.col("config") == c, rounded(F.col("recall") * 100, 1))).alias(c) for c in configs])


def read_gold(spark: SparkSession, path: str, wanted: Sequence[str] = ("direct", "paraphrased")) -> DataFrame:
    """query_id, framework, query, gold (list of citations), slice of the JSON lines in path; without a wanted slice, or with a query without gold, an error."""
    rows = spark.read.schema("id string, framework string, query string, gold array<string>, difficulty string").option("mode", "FAILFAST").json(path)
    gold = rows.select(F.col("id").alias("query_id"), "framework", "query", "gold", F.col("difficulty").alias("slice"))
    if missing := [r["slice"] for r in missing_slices(gold, wanted).collect()]:  # of wanted
        raise ValueError(f"the gold set has no queries of {', '.join(sorted(missing))}")
    named = F.assert_true(F.size("gold") > 0, F.concat(F.lit("no gold for "), F.col("query_id"))).isNull()
    return gold.filter(named)


def latency_points(means: DataFrame, latencies: DataFrame, floor_ms: float = 1.0) -> DataFrame:
    """config, x, y: the median latency of each configuration, floor_ms at least, and its nDCG in percent to one place.

    latencies: config, ms. Of an even number the upper median counts.
    """
    listed = latencies.groupBy("config").agg(F.sort_array(F.collect_list("ms")).alias("ms"))  # a row a query and configuration
    median = F.get("ms", F.floor(F.size("ms") / 2).cast("int"))
    return means.join(listed, "config").select("config", F.greatest(median, F.lit(floor_ms)).alias("x"), rounded(F.col("ndcg") * 100, 1).alias("y"))


def report_rows(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """slice, config, line: the rows of the report's tables, recalls in percent, then MRR and nDCG."""
    means = metrics_by_slice(per_query, queries)
    shown = [percent(rounded(F.col(f"recall_{k}"), 3)) for k in DEPTHS] + [fixed(rounded(F.col(m), 3), 3) for m in ("mrr", "ndcg")]
    return means.select("slice", "config", F.concat(F.lit("| "), F.concat_ws(" | ", "config", *shown), F.lit(" |")).alias("line"))


def write_results(path: str, label: str, totals: DataFrame, means: DataFrame, sweep: DataFrame, chosen: DataFrame) -> None:
    """results.json and report.md below path, of small tables: gold_totals(), metrics_by_slice(), weight and ndcg of a sweep, chosen_weight().

    What each query had isn't kept. The report has a table for each slice and marks the chosen weight.
    """
    spark, rows = totals.sparkSession, [r.asDict() for r in means.orderBy("slice", "config").collect()]
    weights, best = [r.asDict() for r in sweep.orderBy("weight").collect()], chosen.first()
    gold = {r["slice"]: {"n_queries": r["n_queries"], "n_labels": r["n_labels"]} for r in totals.collect()}
    results = {"label": label, "gold": gold, "sweep": weights, "chosen_weight": best["weight"], "configs": rows}
    lines = [f"# Retrieval evaluation{f' — {label}' if label else ''}", "", f"{gold.get('all', {}).get('n_queries', 0)} queries with {gold.get('all', {}).get('n_labels', 0)} labels."]
    for name in sorted({r["slice"] for r in rows}):
        lines += ["", f"## {name}", "", "| Configuration | " + " | ".join(f"R@{k}" for k in DEPTHS) + " | MRR | nDCG |", "| --- " * (len(DEPTHS) + 3) + "|"]
        for r in (r for r in rows if r["slice"] == name):
            lines.append(f"| {r['config']} | " + " | ".join(f"{100 * r[f'recall_{k}']:.1f}%" for k in DEPTHS) + f" | {r['mrr']:.3f} | {r['ndcg']:.3f} |")
    lines += ["", "## Weight of the lexical arm", "", "| Weight | nDCG |", "| --- | --- |"]
    lines += [f"| {w['weight']:.2f}{' (chosen)' if w['weight'] == best['weight'] else ''} | {w['ndcg']:.4f} |" for w in weights]
    for name, text in (("results.json", json.dumps(results, indent=2)), ("report.md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
