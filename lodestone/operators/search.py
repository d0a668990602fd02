"""The search and assessment entry points: all arms for many queries, and documents to findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.models import hash_embedding, hash_vectors, routed
from lodestone.functions.text import embedding_text, indexed_text, trimmed
from lodestone.functions.vectors import unit
from lodestone.operators.dense import dense_topk, int8_index, passing_topk
from lodestone.operators.fusion import best_per_chunk, candidates, fused, reranked
from lodestone.operators.grounding import verify_quotes
from lodestone.operators.lexical import TextIndex, bm25_topk, text_index
from lodestone.session import written

MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")
PASSAGES_PER_CONCERN, PASSAGES = 4, 12
DOCUMENT_CHARS = 24_000
# Fixed value: what the stand-in says of a passage, after its heading.
APPLIES = " applies to the handling described here"


@dataclass(frozen=True)
class Options:
    """What a search asks for."""

    mode: str = "hybrid"
    k: int = 10
    candidate_k: int | None = None
    framework: str | None = None
    quantized: bool = False
    weights: tuple[float, float] = (1.0, 1.0)

    def allowed(self) -> Column | None:
        """all or nothing given means no filter."""
        return None if self.framework in (None, "all") else F.col("framework") == self.framework


FIELDS = ("framework", "citation", "heading")


def search_index(corpus: DataFrame) -> TextIndex:
    """The index that searches read: citation, heading and text of each chunk."""
    return text_index(corpus.withColumn("text", indexed_text(F.col("citation"), F.col("heading"), F.col("text"))), "framework")


def search(
    corpus: DataFrame,
    queries: DataFrame,
    options: Options | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """query_id, chunk_idx, score, rank, dense_rank, bm25_rank and the chunk's fields for all queries.

    corpus: chunk_idx, framework, citation, heading, text and, but for bm25, embedding (null for
    chunks without one); queries: query_id, query and, but for bm25, embedding. Without query
    vectors a hybrid search is a lexical one. judge tells the relevance (query_id, chunk_idx,
    relevance) of the candidates that it is given; without it they keep their order. index:
    search_index(corpus), if it was made before.
    """
    options = options or Options()
    if options.mode not in MODES or options.k < 1:
        raise ValueError(f"mode is one of {', '.join(MODES)}, k at least 1")
    wide, allowed = options.candidate_k or candidates(options.k), options.allowed()
    lexical_only = options.mode == "bm25" or "embedding" not in queries.columns
    if lexical_only or options.mode != "dense":
        index = index or search_index(corpus)
    if lexical_only:
        found = bm25_topk(index, queries, options.k, allowed).withColumns({"dense_rank": F.lit(None).cast("long"), "bm25_rank": F.col("rank")})
    else:
        vectors = corpus.filter("embedding is not null").select("chunk_idx", "framework", "embedding")
        vectors = int8_index(vectors) if options.quantized else vectors.withColumn("embedding", unit(F.col("embedding")))
        if options.mode == "dense":
            found = dense_topk(vectors, queries, options.k, allowed).withColumns({"dense_rank": F.col("rank"), "bm25_rank": F.lit(None).cast("long")})
        else:
            arms = dense_topk(vectors, queries, wide, allowed), bm25_topk(index, queries, wide, allowed)
            found = fused(*arms, options.k if options.mode == "hybrid" else wide, options.weights)
    if options.mode == "hybrid_rerank" and not lexical_only:
        none = found.select("query_id", "chunk_idx").limit(0).withColumn("relevance", F.lit(0))
        best = reranked(found, judge(found.select("query_id", "chunk_idx")) if judge else none, options.k)
        found = best.drop("fused_rank").join(found.drop("rank"), ["query_id", "chunk_idx"])
    found = written(found, "found")  # k rows for each query, whose size decides how they meet the chunks
    fields = corpus.select("chunk_idx", *FIELDS).join(found.select("chunk_idx").distinct(), "chunk_idx", "left_semi")
    named = found.join(fields, "chunk_idx")
    return named.select("query_id", "chunk_idx", "score", "rank", "dense_rank", "bm25_rank", *FIELDS)


# Least and most characters of a query, most of a framework's name, most results, most characters of a document and a description.
QUERY_CHARS, FRAMEWORK_CHARS, MOST_RESULTS, DESCRIPTION_CHARS = (2, 500), 64, 20, 2000


def request_problems(requests: DataFrame) -> DataFrame:
    """requests with problems: what is wrong with a search (query, framework, k) or an assessment (document, description); columns that aren't there are not asked for.

    query must be there; the others may be null.
    """
    rules = {
        "query": lambda c: c.isNotNull() & F.char_length(c).between(*QUERY_CHARS), "framework": lambda c: F.char_length(c) <= FRAMEWORK_CHARS, "k": lambda c: c.between(1, MOST_RESULTS),
        "document": lambda c: F.char_length(c) <= DOCUMENT_CHARS, "description": lambda c: F.char_length(c) <= DESCRIPTION_CHARS,
    }
    wrong = [F.when(~F.coalesce(rule(F.col(name)), F.lit(name != "query")), name) for name, rule in rules.items() if name in requests.columns]
    return requests.withColumn("problems", F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"))


def quote_from(text: Column) -> Column:
    """The first sentence of 40 characters or more, else the whole text; 300 characters at most."""
    sentences = F.transform(F.split(text, r"(?<=\.)(?U:\s+)"), trimmed)
    return trimmed(F.substring(F.coalesce(F.get(F.filter(sentences, lambda s: F.char_length(s) >= 40), F.lit(0)), text), 1, 300))


def assess(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, framework, citation, requirement, severity, status, quote, verdict, similarity, supported.

    documents: document_id, text; chunks: chunk_idx, framework, citation, heading, text. The
    models are the deterministic stand-ins: routing by words, hashed embeddings, and the first
    three passages quoted, one sentence of each. Each quote is verified against its passage. chunks
    are read once.
    """
    cut = documents.select("document_id", F.substring("text", 1, DOCUMENT_CHARS).alias("text"))
    frameworks = cut.select("document_id", F.inline(routed(F.col("text"))))
    concerns = frameworks.select("document_id", "framework", F.posexplode("concerns").alias("concern", "query"))
    asked = concerns.select("framework", "concern", "query").distinct().withColumn("embedding", hash_embedding("query"))
    numbered = asked.withColumn("query_id", F.xxhash64("framework", "concern", "query"))
    said = embedding_text(F.col("framework"), F.col("citation"), F.col("heading"), F.col("text"))
    found = written(passing_topk(chunks, numbered, PASSAGES_PER_CONCERN, said, lambda texts: hash_vectors(texts).astype("float32"), "framework"), "found")
    named = found.select("query_id", "chunk_idx", "rank").join(numbered.select("query_id", "framework", "concern"), "query_id")
    passages = best_per_chunk(named.select(F.col("framework").alias("grp"), "concern", "chunk_idx", "rank"), PASSAGES)
    quoted = passages.filter("place <= 3").join(found.dropDuplicates(["chunk_idx"]), "chunk_idx").select(
        F.col("grp").alias("framework"), "citation", "heading", "place", "text", quote_from(F.col("text")).alias("quote")
    )
    findings = frameworks.select("document_id", "framework").join(quoted, "framework")
    claims = findings.withColumn("claim_id", F.concat_ws("|", "document_id", "framework", F.col("place").cast("string")))
    source = F.concat_ws("\n", "heading", "text")
    verdicts = verify_quotes(claims.select("claim_id", "quote", source.alias("source")))
    return claims.join(verdicts, "claim_id").select(
        "document_id", "framework", "citation", F.concat(F.col("heading"), F.lit(APPLIES)).alias("requirement"),
        F.when(F.col("place") == 1, "high").otherwise("medium").alias("severity"), F.when(F.col("place") == 1, "missing").otherwise("partial").alias("status"),
        "quote", "verdict", "similarity", (F.col("verdict") != "unsupported").alias("supported"),
    )
