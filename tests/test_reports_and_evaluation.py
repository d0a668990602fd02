"""Reports as Markdown, saved reports, the gold set and the results of an evaluation on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, evaluation, outcomes, reports, search

HEAD = "report_id string, summary string, assessed_at string, n_sections long, n_chunks long, dimensions int, model string, seconds double, input_tokens long, output_tokens long, cost double"
FRAME = "report_id string, place int, framework string, score long, confidence double, rationale string, has_corpus boolean, n_passages long"
FOUND = "report_id string, framework string, place int, requirement string, severity string, status string, supported boolean, explanation string, document_quote string, document_verdict string, regulation_quote string, citation string, verdict string"


def test_whole_reports_as_markdown(spark):
    heads = [("r1", "A plan.", "2024-01-02", 12, 34, 8, "m", 2.26, 12345, 678, 0.01234), ("r2", "Nothing.", None, 1, 2, 8, "m", 0.5, 0, 0, None)]
    frames = [("r1", 1, "GDPR", 72, 0.8, "Because.", True, 4), ("r1", 0, "SOC 2", None, 0.555, "It says so.", False, 0), ("r2", 0, "HIPAA", 100, 1.0, "Yes.", True, 3)]
    found = [
        ("r1", "GDPR", 1, "Second", "low", "partial", False, "Why not.", "", None, "quote two", "Art. 2", "unsupported"),
        ("r1", "GDPR", 0, "First", "high", "missing", True, "Why.", "said here", None, "quote one", "Art. 1", "exact"),
    ]
    made = reports.to_markdown(spark.createDataFrame(heads, HEAD), spark.createDataFrame(frames, FRAME), spark.createDataFrame(found, FOUND))
    said = {r["report_id"]: r["markdown"] for r in made.collect()}
    assert said["r1"].split("\n\n") == [
        "# Assessment", "- **Assessed:** 2024-01-02\n- **Corpus:** 12 sections, 34 passages, 8d `m`", "## What was read", "A plan.", "## Grounding",
        "1 of 2 findings quote text that stands in the passages (50%).", "1 quote text that was not found; they are marked and count for no score.",
        "## SOC 2", "_Confidence 56%._ It says so.", "> There is no text of it to cite, so it has no findings and no score.",
        "## GDPR — 72/100", "_Confidence 80%._ Because.", "### First", "**high · missing** · quote exact", "Why.", "> said here\n> — the document (not checked)", "> quote one\n> — Art. 1 (exact)",
        "### Second", "**low · partial** · quote unsupported — unsupported, not in the score", "Why not.", "> quote two\n> — Art. 2 (unsupported)",
        "## How it was made", "2.3s, 12,345 input and 678 output tokens, about $0.0123.\n",
    ]
    assert "There were no findings to verify." in said["r2"] and "No findings in the 3 passages found." in said["r2"] and said["r2"].endswith("0.5s, 0 input and 0 output tokens.\n")


def test_saved_reports_have_an_expiry(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    schema = "report_id string, document_hash string, created_at timestamp, expires_at timestamp, pinned boolean, total double"
    old = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "report_id string, pinned boolean").select(
        "report_id", F.lit("h").alias("document_hash"), now.alias("created_at"), F.when(F.col("report_id") == "c", now + F.expr("interval 1 day")).otherwise(now - F.expr("interval 1 day")).alias("expires_at"), "pinned", F.lit(1.0).alias("total")
    )
    left, receipts = reports.saved(old, spark.createDataFrame([("d", " text ", 7.0)], "report_id string, document string, total double"), now)
    assert left.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    rows = {r["report_id"]: r for r in left.collect()}
    assert sorted(rows) == ["a", "c", "d"] and rows["d"]["total"] == 7.0 and not rows["d"]["pinned"]
    assert [(r["report_id"], str(r["expires_at"])[:10]) for r in receipts.collect()] == [("d", "2024-03-31")]
    assert rows["d"]["document_hash"] == spark.range(1).select(reports.document_hash(F.lit("text"))).first()[0]


def test_gold_set(spark, tmp_path):
    rows = [{"id": "q1", "framework": "GDPR", "query": "a", "gold": ["x"], "difficulty": "direct"}, {"id": "q2", "framework": "GDPR", "query": "b", "gold": ["y", "z"], "difficulty": "paraphrased"}]
    file = tmp_path / "gold.jsonl"
    file.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    assert [(r["query_id"], r["gold"], r["slice"]) for r in evaluation.read_gold(spark, str(file)).orderBy("query_id").collect()] == [("q1", ["x"], "direct"), ("q2", ["y", "z"], "paraphrased")]
    with pytest.raises(ValueError, match="lookup"):
        evaluation.read_gold(spark, str(file), ("direct", "lookup"))
    file.write_text("\n".join(json.dumps(r | {"gold": []}) for r in rows))
    with pytest.raises(Exception, match="no gold for q"):
        evaluation.read_gold(spark, str(file)).collect()


def test_results_of_an_evaluation(spark, tmp_path):
    per = spark.createDataFrame([("a", 1, *[1.0] * 4, 1.0, 1.0), ("a", 2, *[0.0] * 4, 0.0, 0.25), ("b", 1, *[0.5] * 4, 0.5, 0.5), ("b", 2, *[0.5] * 4, 0.5, 0.5)], "config string, query_id long, recall_1 double, recall_3 double, recall_5 double, recall_10 double, mrr double, ndcg double")
    asked = spark.createDataFrame([(1, "direct"), (2, "paraphrased")], "query_id long, slice string")
    gold = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "query_id long, citation string")
    lines = {(r["slice"], r["config"]): r["line"] for r in evaluation.report_rows(per, asked).collect()}
    assert lines["all", "a"] == "| a | 50.0% | 50.0% | 50.0% | 50.0% | 0.500 | 0.625 |" and lines["direct", "b"].endswith("| 0.500 | 0.500 |")
    sweep, chosen = (spark.createDataFrame(rows, "weight double, ndcg double") for rows in ([(0.3, 0.9), (0.1, 0.8)], [(0.3, 0.9)]))
    evaluation.write_results(str(tmp_path), "test", evaluation.gold_totals(gold, asked), evaluation.metrics_by_slice(per, asked), sweep, chosen)
    said = json.loads("\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/results.json").collect()))
    assert said["gold"]["all"] == {"n_queries": 2, "n_labels": 3} and said["chosen_weight"] == 0.3 and [w["weight"] for w in said["sweep"]] == [0.1, 0.3]
    assert {(c["slice"], c["config"]) for c in said["configs"]} == {(s, c) for s in ("all", "direct", "paraphrased") for c in "ab"}
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/report.md").collect())
    assert "| a | 100.0% | 100.0% | 100.0% | 100.0% | 1.000 | 1.000 |" in text and "| 0.30 (chosen) | 0.9000 |" in text


def test_latency_has_a_floor_and_the_upper_median(spark):
    means = spark.createDataFrame([("a", 0.5), ("b", 0.123)], "config string, ndcg double")
    ms = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 3.0), ("b", 9.0), ("b", 5.0), ("b", 7.0)], "config string, ms double")
    assert sorted(map(tuple, evaluation.latency_points(means, ms).collect())) == [("a", 1.0, 50.0), ("b", 7.0, 12.3)]


def test_requests_and_prompts(spark):
    rows = [(1, "ab", None, None, None), (2, "a", "f" * 65, 21, None), (3, None, "f", 0, "d" * 24_001), (4, "q" * 501, "all", 20, "d" * 24_000)]
    found = search.request_problems(spark.createDataFrame(rows, "id long, query string, framework string, k int, document string"))
    assert {r["id"]: r["problems"] for r in found.collect()} == {1: [], 2: ["query", "framework", "k"], 3: ["query", "k", "document"], 4: ["query"]}
    shown = spark.createDataFrame([(1, "why", 1, "B", "y" * 900), (1, "why", 0, "A", "x")], "query_id long, query string, position int, heading string, text string")
    assert outcomes.rerank_prompts(shown).first()["prompt"] == f"Question: why\n\n[0] A\nx\n\n[1] B\n{'y' * 700}\n\nAnswer with a relevance of 0 to 3 for each of the 2 passages."


def test_counts_of_what_was_pushed(spark):
    table = spark.createDataFrame([("a",), ("b",), ("a",)], "source string")
    assert {r["source"]: r["n"] for r in reports.group_counts(table, "source").collect()} == {None: 3, "a": 2, "b": 1}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_idx long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8])], "query_id long, embedding array<float>")
    assert tuple(dense.self_probe(vectors, asked).first()) == (3, 2)
