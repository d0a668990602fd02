"""The index on disk, searches by blocks and lists, ceilings, caches, checked answers, traces and events on small tables."""

from __future__ import annotations

import json
import re
import shutil
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructType

from lodestone import session
from lodestone.functions.text import indexed_text, term_of
from lodestone.operators import answers, approximate, dense, lexical, metering, reports, search, tracing
from lodestone.plans import catalogue
from lodestone.sources import embeddings, sections
from lodestone.streaming import events, limits
from lodestone.streaming.cache import by_cache


def test_searches_read_the_blocks_of_their_terms(spark, tables):
    index = lexical.text_index(catalogue.A.corpus(spark, tables), "framework")
    asked = catalogue.A.queries(spark, tables).filter("query_id < 3").withColumn("query", F.substring_index("query", " ", 4))
    terms = [r["term"] for r in lexical.query_terms(asked).collect()]
    found = lexical.bm25_topk(index, asked)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    blocks = {r["b"] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(lexical.block_of(F.col("t"), index.blocks).alias("b")).collect()}
    scans = [s for s in plan.split("\n\n") if "Scan parquet" in s and "chunk_idx" in s and "tf" in s]
    filters = [re.search(r"PartitionFilters: \[(.*)\]", s) for s in scans]
    assert blocks and filters and all(f and "block" in f[1] and all(str(b) in f[1] for b in blocks) for f in filters)
    read = {r["f"] for r in index.of(lexical.query_terms(asked)).select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and {int(re.search(r"block=(\d+)", f)[1]) for f in read} == blocks and len(blocks) < index.blocks
    whole = lexical.bm25_topk(catalogue.A.corpus(spark, tables), asked)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, found.collect()))


def cover_score(places: list[list[int]]) -> float:
    """Over every start and end: spans with all terms that hold no smaller one."""
    entries = sorted((at, t) for t, own in enumerate(places) for at in own)
    spans = [(a, b) for a in range(len(entries)) for b in range(a, len(entries)) if {t for _, t in entries[a : b + 1]} == set(range(len(places)))]
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(0.1 / (1 + entries[b][0] - entries[a][0] - (b - a)) for a, b in least)


def test_cover_density_against_all_spans(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "the", "of", "delta"]
    rows = [(k, " ".join(rng.choice(words, 14))) for k in range(60)] + [(99, None), (98, ""), (97, "beta alpha")]
    queries = [(1, "alpha beta"), (2, "gamma"), (3, "alpha gamma delta alpha"), (4, "the of"), (5, "nowhere alpha")]
    corpus = spark.createDataFrame(rows, "chunk_idx long, text string")
    found = {(r["query_id"], r["chunk_idx"]): r["score"] for r in lexical.cover_density(corpus, spark.createDataFrame(queries, "query_id long, query string")).collect()}
    expected = {}
    for q, query in queries:
        wanted = list(dict.fromkeys(t for t in map(term_of, query.split()) if t))
        for c, text in rows:
            places = [[k for k, w in enumerate((text or "").split(), 1) if term_of(w) == t] for t in wanted]
            if wanted and all(places):
                expected[q, c] = cover_score(places)
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 2e-6 for k, v in expected.items())


def test_index_with_postings_and_steps(spark, tmp_path):
    rows = [(1, "GDPR", "Art. 5", "Principles", "lawful processing"), (2, "HIPAA", "164.312", "Safeguards", "access control")]
    chunks = spark.createDataFrame(rows, "chunk_idx long, framework string, citation string, heading string, text string")
    vectors = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 0.0])], "chunk_idx long, embedding array<float>")
    sections.write_index(chunks, vectors, spark.createDataFrame([(2,)], "dimensions int"), f"{tmp_path}/index", quantised=True, searched=True)
    kept, postings = sections.read_index(spark, f"{tmp_path}/index"), sections.read_postings(spark, f"{tmp_path}/index")
    asked = spark.createDataFrame([(7, "safeguards", [1.0, 0.1])], "query_id long, query string, embedding array<float>")
    assert [r["chunk_idx"] for r in dense.dense_topk(kept["vectors"], asked, 2).orderBy("rank").collect()] == [2, 1]
    found = search.search(kept["chunks"], asked, search.Options("bm25"), index=postings).collect()
    assert [(r["citation"], r["framework"]) for r in found] == [("164.312", "HIPAA")]
    whole = lexical.bm25_topk(chunks.withColumn("text", indexed_text(F.col("citation"), F.col("heading"), F.col("text"))), asked)
    assert [tuple(r) for r in whole.collect()] == [(r["query_id"], r["chunk_idx"], r["score"], r["rank"]) for r in found]


def test_indexes_are_made_again(spark, tmp_path):
    """After scratch is cleared, and when the files of the tables change."""
    for name in ("documents", "embeddings", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = catalogue.document_index(spark, str(tmp_path))
    assert catalogue.document_index(spark, str(tmp_path)) is first
    session.cleared()
    again = catalogue.document_index(spark, str(tmp_path))
    assert again is not first and again.postings.count() > 0
    time.sleep(0.05)
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(3).toPandas().to_parquet(tmp_path / "documents.parquet")
    assert catalogue.document_index(spark, str(tmp_path)).n_chunks == 3


def test_int8_products(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(500, 16)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "chunk_idx long, embedding array<float>")
    asked = vectors.filter("chunk_idx % 20 = 0").withColumnRenamed("chunk_idx", "query_id")
    found = dense.dense_topk(dense.int8_index(vectors), asked, 3).collect()
    scale = np.abs(data.astype(np.float64)).max(axis=1) / 127
    steps = np.floor(data / scale[:, None] + 0.5)
    scores = np.floor((data[::20].astype(np.float64) @ steps.T) * scale.astype(np.float32).astype(np.float64) * 1e6 + 0.5) / 1e6
    assert {(r["query_id"], r["rank"]): r["chunk_idx"] for r in found} == {
        (20 * q, n + 1): c for q, row in enumerate(scores) for n, c in enumerate(np.lexsort((np.arange(500), -row))[:3].tolist())
    }


@pytest.mark.parametrize("skewed", [False, True])
def test_approximate_search_reaches_its_recall(spark, skewed):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 24))
    which = np.where(rng.random(3000) < 0.5, 0, rng.integers(0, 12, 3000)) if skewed else rng.integers(0, 12, 3000)
    data = (centres[which] + rng.normal(size=(3000, 24)) * 0.7).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)] + [(9999, None)], "chunk_idx long, embedding array<float>").repartition(4)
    index = approximate.vector_index(vectors)
    assert index.rows.count() == 3000
    asked = vectors.filter("chunk_idx % 20 = 0").withColumnRenamed("chunk_idx", "query_id")
    told = dense.parity(dense.dense_topk(vectors, asked, 10), approximate.approximate_topk(index, asked, 10)).first()
    assert told["n_queries"] == 150 and told["mean_overlap"] >= 0.95 and told["max_score_delta"] <= 1e-6
    every = dense.parity(dense.dense_topk(vectors, asked, 10), approximate.approximate_topk(index, asked, 10, probes=len(index.centroids))).first()
    assert every["mean_overlap"] >= 0.999
    none = approximate.vector_index(vectors.limit(0))
    assert approximate.approximate_topk(none, asked).count() == approximate.approximate_topk(index, asked.limit(0)).count() == 0


def plain_ceiling(rows, limit, window_ms, daily):
    out, state = {}, {}
    for call, bucket, visitor, t in sorted(rows, key=lambda r: (r[3], r[0])):
        own = state.setdefault(bucket, {"opened": t, "total": 0, "seen": {}})
        if t - own["opened"] > 86_400_000:
            own["opened"], own["total"] = t, 0
        count, start = own["seen"].get(visitor, (0, t))
        if t - start > window_ms:
            count, start = 0, t
        ok = own["total"] < daily and count < limit
        if ok:
            own["total"] += 1
            own["seen"][visitor] = (count + 1, start)
        out[call] = ok
    return out


@pytest.mark.parametrize(("window_h", "daily"), [(1, 30), (30, 25), (50, 7), (8, 0), (8, 10_000)])
def test_ceiling_of_busy_buckets(spark, window_h, daily):
    """Windows longer than a day carry the effect of one day's ceiling to the next ones."""
    rng = np.random.default_rng(window_h + daily)
    at = np.sort(rng.integers(0, 9 * 86_400_000, 900)).tolist()
    rows = [(k, "a" if rng.random() < 0.8 else "b", f"v{rng.integers(15)}", t - t % 60_000 if k % 5 == 0 else t) for k, t in enumerate(at)]
    table = spark.createDataFrame(rows, "call_id long, bucket string, visitor string, at_ms long").repartition(5)
    found = metering.anchored_ceiling(table, 3, window_h * 3_600_000, daily)
    assert {r["call_id"]: r["allowed"] for r in found.collect()} == plain_ceiling(rows, 3, window_h * 3_600_000, daily)
    assert metering.anchored_ceiling(table.limit(0), 3, 1000, daily).count() == 0


def test_ceiling_of_a_stream_over_triggers(spark, tmp_path):
    rng = np.random.default_rng(12)
    at = np.sort(rng.integers(0, 4 * 86_400_000, 400)).tolist()
    rows = [(k, "ab"[int(rng.integers(2))], f"v{rng.integers(9)}", t) for k, t in enumerate(at)]
    schema = "call_id long, bucket string, visitor string, at timestamp"
    for k in range(4):
        part = spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "call_id long, bucket string, visitor string, at_ms long")
        part.select("call_id", "bucket", "visitor", F.timestamp_millis("at_ms").alias("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    limited = limits.ceiling_limit(read, 2, 3_600_000 * 5, 20)
    limited.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {r["call_id"]: r["allowed"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == plain_ceiling(rows, 2, 3_600_000 * 5, 20)


def test_hits_are_not_charged(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    kept = spark.createDataFrame([("r1", "one"), ("r2", "two")], "report_id string, text string").select(
        "report_id", reports.document_hash(F.col("text")).alias("document_hash"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.when(F.col("report_id") == "r1", F.lit("2024-03-01")).otherwise("2024-01-15").cast("timestamp").alias("expires_at"),
    )
    asked = spark.createDataFrame([(1, " one\n"), (2, "two"), (3, "sample"), (4, None), (5, "three")], "request_id long, document string")
    hits, misses = by_cache(asked, kept, "sample", now)
    assert [tuple(r) for r in hits.select("request_id", "report_id").collect()] == [(1, "r1")]
    assert sorted(r["request_id"] for r in misses.collect()) == [2, 3, 4, 5]


def test_embeddings_are_computed_once(spark, tmp_path):
    asked = []

    def embed(missing):
        asked.extend(sorted(r["text"] for r in missing.collect()))
        return missing.select("key", F.array(F.char_length("text"), F.lit(1)).alias("embedding"))

    texts = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "doc_id long, text string")
    path = f"{tmp_path}/store"
    first = embeddings.embedded(texts.filter("doc_id < 3"), path, "m", 2, embed)
    assert sorted((r["doc_id"], r["embedding"]) for r in first.collect()) == [(1, [2.0, 1.0]), (2, [1.0, 1.0])]
    every = {r["doc_id"]: r["embedding"] for r in embeddings.embedded(texts, path, "m", 2, embed).collect()}
    assert every == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None, 5: [0.0, 1.0]} and asked == ["aa", "b", ""]
    embeddings.embedded(texts, path, "m", 2, embed)
    assert asked == ["aa", "b", ""] and embeddings.stored(spark, path).count() == 3
    added = next(Path(path).glob("added=2-*"))
    shutil.copytree(added, added.with_name("added=again"))  # an addition that came twice
    assert embeddings.stored(spark, path).count() == 3
    embeddings.embedded(texts, path, "other", 2, embed)
    assert embeddings.stored(spark, path).count() == 6
    with pytest.raises(Exception, match="3 numbers"):
        embeddings.embedded(texts, path, "m", 3, embed)


SCHEMA = StructType([
    answers.field("name", StringType(), least_chars=2, description="who"), answers.field("kind", StringType(), one_of=("x", "y")), answers.field("share", DoubleType(), least=0, most=1),
    answers.field("n", LongType(), optional=True, least=0), answers.field("ok", BooleanType()), answers.field("tags", ArrayType(StringType()), least_items=1, most_items=2),
    answers.field("inner", StructType([answers.field("at", LongType())]), optional=True),
])
GOOD = {"name": "ab", "kind": "x", "share": 0.5, "n": 3, "ok": True, "tags": ["t"], "inner": {"at": 1}}


def test_answers_are_checked(spark):
    cases = {
        json.dumps(GOOD): [], "Well:\n```json\n" + json.dumps(GOOD) + "\n```": [], json.dumps(GOOD | {"n": None, "more": 1}): [], json.dumps({k: v for k, v in GOOD.items() if k not in ("n", "inner")}): [],
        "nothing": ["(root): no JSON"], '{"name": "ab"': ["(root): no JSON"], json.dumps([GOOD]): ["(root): an object is asked for"],
        json.dumps(GOOD | {"name": 5, "kind": "z", "share": 2}): ["name: a text is asked for", "kind: not one of the allowed values", "share: too large"],
        json.dumps(GOOD | {"name": "a", "n": 1.5, "ok": "true"}): ["name: too short", "n: a whole number is asked for", "ok: true or false is asked for"],
        json.dumps(GOOD | {"tags": []}): ["tags: too few items"], json.dumps(GOOD | {"tags": ["a", 1, "c"]}): ["tags: too many items", "tags.1: a text is asked for"],
        json.dumps(GOOD | {"tags": "a", "inner": {}}): ["tags: a list is asked for", "inner.at: missing"], json.dumps(GOOD | {"inner": {"at": "1"}, "n": -1}): ["n: too small", "inner.at: a whole number is asked for"],
    }
    table = spark.createDataFrame([(k, None) for k in cases], "reply string, other string").union(spark.createDataFrame([(None, None)], "reply string, other string"))
    found = {r["reply"]: r for r in answers.checked(table, SCHEMA).collect()}
    assert {k: r["issues"] for k, r in found.items()} == {**cases, None: ["(root): no JSON"]}
    assert all((r["value"] is not None) == r["valid"] == (not r["issues"]) for r in found.values())
    assert found[json.dumps(GOOD)]["value"].asDict(recursive=True) == GOOD


def test_a_reply_is_parsed_once_for_all_fields(spark):
    """The plan of the check does not grow with the schema."""
    table = spark.createDataFrame([("{}",)], "reply string")

    def variants(schema):
        return answers.checked(table, schema)._jdf.queryExecution().optimizedPlan().toString().count("variant")

    assert variants(SCHEMA) == variants(StructType(SCHEMA[:1]))


def test_odd_replies(spark):
    schema = StructType([answers.field("a", LongType(), optional=True, least=0), answers.field("b", ArrayType(ArrayType(StringType())), optional=True)])
    cases = {
        '{"a": 1} and {"a": "x"}': [], '[1] {"a": 1}': ["(root): an object is asked for"], '``` {"a": 1}': [], '``````{"a": 1}': ["(root): no JSON"], '{"a": "x"}\n```\n{"a": 2}\n```': [],
        '{"a": 1, "a": 2}': ["(root): no JSON"], '{"a": NaN}': ["(root): no JSON"], '{"a": 1e3}': [], '{"a": 1e30}': ["a: a whole number is asked for"], '{"a": 10000000000000000000000}': ["a: a whole number is asked for"],
        '{"a": true}': ["a: a whole number is asked for"], '{"b": [["x", null], null, ["y", 1]]}': ["b.0.1: a text is asked for", "b.1: a list is asked for", "b.2.1: a text is asked for"], "{}": [], "": ["(root): no JSON"],
    }
    found = answers.checked(spark.createDataFrame([(k,) for k in cases], "reply string"), schema).collect()
    assert {r["reply"]: r["issues"] for r in found} == cases


def test_schema_of_a_call():
    said = answers.json_schema(SCHEMA)
    assert said["required"] == ["name", "kind", "share", "ok", "tags"] and said["properties"]["kind"] == {"type": "string", "enum": ["x", "y"]}
    assert said["properties"]["tags"] == {"type": "array", "items": {"type": "string"}} and said["properties"]["name"]["description"] == "who"
    assert said["properties"]["n"] == {"type": "integer"} and said["properties"]["share"] == {"type": "number"}
    assert "required" not in answers.json_schema(StructType([answers.field("a", BooleanType(), optional=True)]))
    with pytest.raises(ValueError, match="map"):
        answers.json_schema(StructType([answers.field("a", MapType(StringType(), StringType()))]))
    with pytest.raises(ValueError, match="no such rule"):
        answers.field("a", StringType(), longest=3)


def test_one_repair_and_quarantine(spark):
    schema, prompts = StructType([answers.field("a", LongType(), least=1)]), []
    said = {(1, 1): '{"a": 1}', (2, 1): '{"a": 0}', (2, 2): '{"a": 2}', (3, 1): "no", (3, 2): "{}", (4, 2): '{"a": 4}'}

    def model(calls):
        prompts.extend((r["call_id"], r["attempt"], r["prompt"]) for r in calls.collect())
        return calls.join(spark.createDataFrame([(*k, v) for k, v in said.items()], "call_id long, attempt int, reply string"), ["call_id", "attempt"])

    calls = spark.createDataFrame([(k, f"ask {k}") for k in (1, 2, 3, 4)], "call_id long, prompt string")
    found = {r["call_id"]: (r["attempts"], r["valid"], r["issues"], r["value"] and r["value"]["a"]) for r in answers.answered(calls, schema, model).collect()}
    assert found == {1: (1, True, [], 1), 2: (2, True, [], 2), 3: (2, False, ["a: missing"], None), 4: (2, True, [], 4)}
    second = {k: p for k, attempt, p in prompts if attempt == 2}
    assert sorted(second) == [2, 3, 4] and '{"a": 0}' in second[2] and "- a: too small" in second[2] and second[2].startswith("ask 2")


def test_spans_of_queries_and_streams(spark, tmp_path):
    trace = tracing.Trace(spark, "r")
    kept = trace.record("numbers", "generate", lambda: spark.range(10).select("id", (F.col("id") * 2).alias("input_tokens"), F.lit(1).alias("output_tokens")), model="gemini-3.6-flash")
    assert kept.count() == 10
    with pytest.raises(Exception, match="RESOURCE_EXHAUSTED"):
        trace.record("fails", "retrieve", lambda: spark.range(3).select(F.raise_error(F.lit("429 RESOURCE_EXHAUSTED"))))
    listener = tracing.StreamSpans(trace, "retrieve")
    spark.streams.addListener(listener)
    spark.range(7).write.parquet(f"{tmp_path}/in")
    spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.queryName("seen").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    deadline = time.time() + 20
    while time.time() < deadline and len(trace._spans) < 3:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    rows = {r["name"]: r for r in trace.spans().collect()}
    assert (rows["numbers"]["n_rows"], rows["numbers"]["input_tokens"], rows["numbers"]["output_tokens"], rows["numbers"]["error"]) == (10, 90, 10, None)
    assert rows["fails"]["error"] == "model-busy" and rows["fails"]["n_rows"] is None and rows["seen"]["n_rows"] == 7
    cost = metering.trace_costs(trace.spans()).first()
    assert (cost["input_tokens"], cost["output_tokens"], cost["cost"]) == (90, 10, 0.000052)


def test_events_once_and_in_order(spark, tmp_path):
    """A stream that is killed before a trigger is committed repeats it; each event is there once, and failures end with an error."""
    for k in range(3):
        spark.createDataFrame([(f"d{k}{n}", n) for n in range(4)], "document_id string, n long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema("document_id string, n long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def assess(rows):
        if rows.filter("document_id = 'd10'").count():
            raise RuntimeError("request timed out")
        return rows.filter("n > 0").select("document_id", F.explode(F.array(F.lit("B"), F.lit("A"))).alias("framework"), F.col("n").alias("score"))

    run = lambda: events.assessed_stream(read, assess, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    run()
    first = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/*").collect())
    for name in ("2", ".2.crc"):  # as if it had ended before the commit of the last trigger
        (tmp_path / "state" / "commits" / name).unlink()
    run()
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/*").collect()) == first
    by: dict[str, list] = {}
    for file in sorted(Path(f"{tmp_path}/out").glob("batch=*/part-*")):
        for line in map(json.loads, file.read_text().splitlines()):
            by.setdefault(line["document_id"], []).append((line["seq"], line["type"], line.get("framework"), line.get("message")))
    assert len(by) == 12
    for name, own in by.items():
        assert [s for s, *_ in own] == list(range(len(own))) and own[0][1] == "start"
        if name[1] == "1":
            assert [e[1:] for e in own[1:]] == [("error", None, "model-timeout")]
        else:
            assert [e[1:3] for e in own[1:]] == ([("framework", "A"), ("framework", "B")] if name[2] != "0" else []) + [("done", None)]


def test_last_written_report_counts(spark):
    old = spark.createDataFrame([(1, "a", 1.0)], "id long, name string, total double")
    new = spark.createDataFrame([(1, "b", 9.0, 1), (1, "c", 2.0, 2), (2, "d", 5.0, 2), (2, "e", 4.0, 1)], "id long, name string, total double, at int")
    assert sorted(map(tuple, reports.upsert(old, new, "id", ["total"], "at").collect())) == [(1, "a", 2.0), (2, "d", 5.0)]


def test_paragraphs_with_attributes_and_without_end(spark):
    html = f"<p class='x'>{'one ' * 30}</p><pre>no</pre><P>{'two ' * 30}<p>{'three ' * 30}<script>var p = '<p>no</p>'</script>"
    rows = sections.page_sections(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r["para"], r["text"].split()[0]) for r in rows] == [(0, "one"), (1, "two"), (2, "three")]
