"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chat import maximal_conversations
from lodestone.llm.collocations import FIRST, LEAST, LONGEST, UNDETERMINED, collocations
from lodestone.llm.decontamination import WINDOW, contaminated
from lodestone.llm.embedding_dedup import embedding_links
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language import language_of
from lodestone.llm.packing import pack
from lodestone.llm.pages import main_texts
from lodestone.llm.pii import KINDS, find_personal_data, span_string
from lodestone.llm.sentencepiece import round_trip
from lodestone.llm.simhash import simhash_groups
from lodestone.llm.token_counts import token_counts
from lodestone.llm.whitening import whitened

MAX_TOKENS = 2048


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of(_table(spark, sf_dir, "documents"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(_table(spark, sf_dir, "conversations"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"))


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def number(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op10_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(_table(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_chat_collapse": op4_chat_collapse,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_bestfit_packing": op6_bestfit_packing,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_pii_weak": op8_pii_weak,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_consensus": op10_html_consensus,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_chat_collapse": """
        WITH t AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
            FROM conversations GROUP BY conv_id),
        g AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM t GROUP BY l),
        p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM t))
        SELECT conv_id, len(l) AS n_turns, n_copies, array_to_string(list_transform(l, lambda x:
            '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)), '') AS rendered
        FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)""",
    "op9_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op11_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS size, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS words
            FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
            SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
            FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
        met AS (SELECT r, size, i, item_id FROM places JOIN windows USING (size, words)),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS p FROM met) GROUP BY r),
        named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op12_collocations": f"""
        WITH p AS (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
            FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (SELECT unnest(generate_series(1, {LONGEST})) AS m) WHERE len(w) >= m)
            GROUP BY ALL HAVING count(*) >= {LEAST}),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
        inside AS (
            SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS outer_a
            FROM (SELECT *, unnest(generate_series(1, m - s + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS s FROM c))),
        kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = c.lang AND inside.phrase = c.phrase AND 100 * outer_a >= 100 * c.a)),
        cuts AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM kept)),
        scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, k, h.a AS l, t.a AS r, n, (1000::HUGEINT * cuts.a * n // (h.a::HUGEINT * t.a))::BIGINT AS score
            FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail JOIN n ON n.lang = cuts.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
        QUALIFY rank <= {FIRST}""",
}
