"""Reciprocal rank fusion and the listwise rerank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lexical import ranked

RRF_K = 60
# The weights that a sweep tries, in order.
WEIGHTS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)


def candidates(k: int) -> int:
    """How many rows each arm gives to a fusion of k."""
    return max(5 * k, 50)


def fused(dense: DataFrame, lexical: DataFrame, k: int = 10, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """query_id, chunk_idx, dense_rank, bm25_rank, score, rank from two rankings.

    A union and one aggregate instead of an outer join. Ties: dense rank first, rows without one
    last, then lexical rank.
    """
    both = dense.select("query_id", "chunk_idx", F.col("rank").alias("dense_rank"), F.lit(None).cast("long").alias("bm25_rank")).unionByName(
        lexical.select("query_id", "chunk_idx", F.lit(None).cast("long").alias("dense_rank"), F.col("rank").alias("bm25_rank"))
    )
    arms = both.groupBy("query_id", "chunk_idx").agg(F.min("dense_rank").alias("dense_rank"), F.min("bm25_rank").alias("bm25_rank"))
    return _scored(arms.withColumn("w_dense", F.lit(weights[0])).withColumn("w_lexical", F.lit(weights[1])), k).drop("w_dense", "w_lexical")


def _score():
    def arm(weight: str, rank: str):
        return F.coalesce(F.col(weight) / (RRF_K + F.col(rank)), F.lit(0.0))

    return F.floor((arm("w_dense", "dense_rank") + arm("w_lexical", "bm25_rank")) * 1e9 + 0.5) / 1e9


def _scored(arms: DataFrame, k: int) -> DataFrame:
    return ranked(arms.withColumn("score", _score()), k, F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))


def sweep(dense: DataFrame, lexical: DataFrame, k: int = 10, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """lexical_weight, query_id, chunk_idx, score, rank for all weights in one job."""
    arms = fused(dense, lexical, 1 << 30).drop("score", "rank")
    grid = F.explode(F.array(*map(F.lit, weights)))
    many = arms.withColumn("w_dense", F.lit(1.0)).withColumn("w_lexical", grid).withColumn("score", _score())
    window = Window.partitionBy("w_lexical", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    best = many.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)
    return best.select(F.col("w_lexical").alias("lexical_weight"), "query_id", "chunk_idx", "score", "rank")


def configured(dense: DataFrame, lexical: DataFrame, configs: dict[str, tuple[float, float]], k: int = 10) -> DataFrame:
    """config, query_id, chunk_idx, score, rank for all configurations in one job.

    A configuration is a pair of weights; rows that no arm with weight has are left out.
    """
    arms = fused(dense, lexical, 1 << 30).drop("score", "rank")
    named = [F.struct(F.lit(n).alias("config"), F.lit(a).alias("w_dense"), F.lit(b).alias("w_lexical")) for n, (a, b) in configs.items()]
    many = arms.select("*", F.inline(F.array(*named))).withColumn("score", _score()).filter("score > 0")
    window = Window.partitionBy("config", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    best = many.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)
    return best.select("config", "query_id", "chunk_idx", "score", "rank")


def reranked(found: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """found (query_id, chunk_idx, rank) in the order of judged (query_id, chunk_idx, relevance).

    Rows without a judgement keep a relevance of -1; ties keep the former rank. Of repeated
    judgements the one with the greatest at counts, if there is that column, else the greatest.
    """
    last = F.max_by("relevance", F.struct("at", "relevance")) if "at" in judged.columns else F.max("relevance")
    told = judged.groupBy("query_id", "chunk_idx").agg(last.alias("relevance"))
    both = found.select("query_id", "chunk_idx", F.col("rank").alias("fused_rank")).join(told, ["query_id", "chunk_idx"], "left")
    both = both.withColumn("relevance", F.coalesce("relevance", F.lit(-1)))
    window = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "fused_rank")
    return both.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)


def best_per_chunk(found: DataFrame, limit: int = 12) -> DataFrame:
    """grp, chunk_idx, best_rank, place: rankings of several concerns merged for each group.

    found: grp, concern (its number), chunk_idx, rank. A chunk counts with its best rank, and the
    first concern that has it breaks ties.
    """
    best = found.groupBy("grp", "chunk_idx").agg(F.min(F.struct("rank", "concern")).alias("best"))
    window = Window.partitionBy("grp").orderBy("best.rank", "best.concern", "chunk_idx")
    placed = best.withColumn("place", F.row_number().over(window).cast("long")).filter(F.col("place") <= limit)
    return placed.select("grp", "chunk_idx", F.col("best.rank").alias("best_rank"), "place")


