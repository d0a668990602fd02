"""Operators against plain restatements and on odd rows, where no SQL says what they should give."""

from __future__ import annotations

import io
import json
import math
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, dense, evaluation, fusion, lexical, metering, outcomes, search
from lodestone.plans import adapters
from lodestone.plans.catalogue import QUERIES
from lodestone.sources import sections, uploads

SPACE = "[\t-\r \x85\xa0  -     　]"


def plain_chunks(text, target, overlap, least):
    """Chunks as they are defined, unit by unit, with every count made from the text itself."""

    def tokens(t):
        return math.ceil(sum(1 for w in re.split(SPACE + "+", t) if w) * 1.3)

    def trim(t):
        return re.sub(f"^{SPACE}+|{SPACE}+$", "", t)

    units = []
    for paragraph in filter(None, map(trim, re.split(r"\n+", text or ""))):
        if tokens(paragraph) <= target:
            units.append(paragraph)
            continue
        open_ = ""
        for sentence in re.split(f"(?<=[.;:]){SPACE}+", paragraph):
            both = sentence if open_ == "" else f"{open_} {sentence}"
            if open_ and tokens(both) > target:
                units.append(open_)
                both = sentence
            open_ = both
        if open_:
            units.append(open_)
    out, body = [], []
    for unit in units:
        if body and sum(map(tokens, body)) + tokens(unit) > target:
            out.append(body)
            carried = []
            for before in reversed(body):
                if sum(map(tokens, carried)) + tokens(before) > overlap:
                    break
                carried.insert(0, before)
            body = carried
        body = [*body, unit]
    joined = ["\n".join(b) for b in [*out, body] if b]
    long = [b for b in joined if tokens(b) >= least]
    return [(b, tokens(b)) for b in long or joined[:1]]


@pytest.mark.parametrize(("target", "overlap"), [(320, 64), (160, 32), (320, 0), (20, 8)])
def test_chunks_of_whole_tables(spark, tables, target, overlap):
    odd = [None, "", " \n\n ", "one", "a. b; c: " * 100, "word " * 2000, "p1\np2\n\n\np3", " x \n y."]
    corpus = adapters.corpus(spark, tables).select("chunk_idx", "framework", "citation", "heading", "text")
    rows = [tuple(r) for r in corpus.collect()] + [(10_000 + k, "en", f"odd:{k}", None, t) for k, t in enumerate(odd)]
    table = spark.createDataFrame(rows, corpus.schema).withColumn("ordinal", F.lit("clash")).repartition(4)
    found = chunking.chunk_sections(table, target, overlap).collect()
    expected = {(i, n): (b, t, len(c)) for i, _, _, _, text in rows for c in [plain_chunks(text, target, overlap, 32)] for n, (b, t) in enumerate(c)}
    assert {(r["chunk_idx"], r["ordinal"]): (r["text"], r["tokens"], r["ordinal_of"]) for r in found} == expected and len(found) == len(expected)
    assert {r["id"] for r in found if r["chunk_idx"] == 10_003} == {"en:odd-3:0"}


def test_chunk_numbers(spark, tables):
    texts = [r["text"] for r in adapters.corpus(spark, tables).collect()]
    sizes = {c: [t for x in texts for _, t in plain_chunks(x, *c, 32)] for c in chunking.SWEEP}
    for r in QUERIES["chunk_size_sweep"](spark, tables).collect():
        mine = sizes[r["target"], r["overlap"]]
        assert r["n_chunks"] == len(mine) and r["avg_tokens"] == pytest.approx(sum(mine) / len(mine), abs=1e-6)
    ordered = sorted(sizes[320, 64])
    n = len(ordered)
    assert tuple(QUERIES["chunk_stats"](spark, tables).first()) == (n, ordered[0], ordered[n // 2], ordered[min(n - 1, int(n * 0.95))], ordered[-1])
    ids = {}
    for r in adapters.corpus(spark, tables).collect():
        for k in range(len(plain_chunks(r["text"], 320, 64, 32))):
            ids[f"{r['framework']}:{r['source']}:{k}"] = ids.get(f"{r['framework']}:{r['source']}:{k}", 0) + 1
    assert {r["id"]: r["n"] for r in QUERIES["duplicate_chunk_ids"](spark, tables).collect()} == {k: n for k, n in ids.items() if n > 1}


def test_json_in_answers(spark):
    cases = {
        '{"a": 1} see {note}': '{"a": 1}', 'so: [1, {"b": "]"}] and ]': '[1, {"b": "]"}]', '```json\n{"a": "}"}\n``` {x}': '{"a": "}"}', '{"a": "\\"}"} x': '{"a": "\\"}"}',
        "none": None, '{"open": [1': '{"open": [1', "": None, None: None, "```\n[1]\n```": "[1]", '{"a": {"b": 2}}}': '{"a": {"b": 2}}',
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.extracted_json(F.col("t")).alias("j")).collect()
    assert {r["t"]: r["j"] for r in rows} == cases


def test_dense_search_in_blocks_and_with_ties(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(-1, 2, (300, 4)).astype(np.float32)
    data[0] = data[1] = [1, 0, 0, 0]
    rows = [(k, v.tolist()) for k, v in enumerate(data) if v.any()]
    table = spark.createDataFrame(rows, "chunk_idx long, embedding array<float>").repartition(4)
    from lodestone.functions.vectors import unit

    vectors = table.withColumn("embedding", unit(F.col("embedding")))
    asked = table.filter("chunk_idx < 50").withColumnRenamed("chunk_idx", "query_id")
    whole, cut = (sorted(map(tuple, dense.dense_topk(vectors, asked, 5, block=b).collect())) for b in (4096, 7))
    assert whole == cut
    units = {k: np.array(v, np.float64) / np.linalg.norm(v) for k, v in rows}
    for q in [k for k, _ in rows if k < 50]:
        scored = sorted(((-math.floor(float(units[q] @ u) * 1e6 + 0.5) / 1e6, k) for k, u in units.items()))[:5]
        assert [(r[1], r[3]) for r in sorted((r for r in whole if r[0] == q), key=lambda r: r[3])] == [(k, n + 1) for n, (_, k) in enumerate(scored)]
    assert dense.dense_topk(vectors, asked.limit(0), 5).count() == dense.dense_topk(vectors.limit(0), asked, 5).count() == 0


def test_search_without_vectors_and_with_fields(spark):
    rows = [(1, "GDPR", "Art. 5", "Principles", "lawful processing of data"), (2, "HIPAA", "164.312", "Safeguards", "access control"), (3, "GDPR", "Art. 32", "Security", "security of processing")]
    corpus = spark.createDataFrame(rows, "chunk_idx long, framework string, citation string, heading string, text string").withColumn("embedding", F.lit(None).cast("array<float>"))
    asked = spark.createDataFrame([(7, "safeguards 164.312"), (8, "processing")], "query_id long, query string")
    found = {(r["query_id"], r["rank"]): (r["citation"], r["dense_rank"], r["bm25_rank"]) for r in search.search(corpus, asked).collect()}
    assert found[7, 1] == ("164.312", None, 1) and len(found) == 3  # the citation is indexed too
    only = search.search(corpus, asked, search.Options("bm25", framework="HIPAA")).collect()
    assert [(r["query_id"], r["framework"]) for r in only] == [(7, "HIPAA")]
    with pytest.raises(ValueError, match="mode"):
        search.search(corpus, asked, search.Options("other"))


def test_empty_corpus_and_queries(spark):
    corpus = spark.createDataFrame([], "chunk_idx long, text string")
    asked = spark.createDataFrame([(1, "word")], "query_id long, query string")
    assert lexical.bm25_topk(corpus, asked).count() == lexical.and_match(corpus, asked).count() == 0
    some = spark.createDataFrame([(1, "word here"), (2, None)], "chunk_idx long, text string")
    assert [(r["chunk_idx"], r["rank"]) for r in lexical.bm25_topk(some, asked).collect()] == [(1, 1)]
    assert lexical.bm25_topk(some, asked.limit(0)).count() == 0


def test_quotes_of_passages(spark):
    long = "This sentence has more than forty characters in it."
    cases = {f"Short one. {long} More.": long, "Too short. All of it.": "Too short. All of it.", "x" * 400: "x" * 300}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", search.quote_from(F.col("t")).alias("q")).collect()
    assert {r["t"]: r["q"] for r in rows} == cases


def test_passage_blocks_come_back(spark):
    rows = [(1, 1, "Art. 5", "Principles", "one\n\ntwo [1] x"), (1, 2, "Art. 6", "Lawful — use", "three"), (2, 1, "A", "B", "")]
    found = spark.createDataFrame(rows, "query_id long, rank long, citation string, heading string, text string")
    back = outcomes.parsed_blocks(outcomes.passage_blocks(found)).collect()
    assert {(r["query_id"], r["rank"], r["citation"]) for r in back} == {r[:3] for r in rows}
    assert {r["text"] for r in back} == {r[4] for r in rows}


def test_shuffled_order(spark):
    assert all(sorted(outcomes.shuffled(n, s)) == list(range(n)) for n in (0, 1, 2, 30) for s in (1, 2))
    assert outcomes.shuffled(30, 1) == outcomes.shuffled(30, 1) != outcomes.shuffled(30, 2)
    found = spark.createDataFrame([(q, 100 + k, k + 1) for q in (1, 2) for k in range(5)], "query_id long, chunk_idx long, rank int")
    rows = outcomes.presented(found).collect()
    order = outcomes.shuffled(5)
    assert all(order[r["position"]] == r["rank"] - 1 for r in rows) and len(rows) == 10


def test_constraints_quarantine(spark):
    good = ("c", 0, "keep records", "met", "low", "because it is written there", "quote of a rule", "Art. 5")
    bad = ("c", 12, None, "odd", None, "short", "short", "")
    table = spark.createDataFrame([good, bad], "case_id string, position int, requirement string, status string, severity string, explanation string, regulation_quote string, citation string")
    kept, out = outcomes.quarantined(table)
    assert [r["position"] for r in kept.collect()] == [0]
    assert out.first()["violations"] == ["citation", "explanation", "number", "regulation_quote", "requirement", "severity", "status"]
    assert outcomes.first_issues(table, 2).first()["issues"] == "12:citation,12:explanation"


def test_ceiling_over_all_visitors(spark):
    """Visitor by visitor against the rule written out; refused calls open no window."""
    rng = np.random.default_rng(9)
    at = np.sort(rng.integers(0, 4 * 86_400_000, 600)).tolist()
    rows = [(k, "ab"[k % 2], f"v{rng.integers(12)}", t) for k, t in enumerate(at)]
    found = {r["call_id"]: (r["allowed"], r["remaining"]) for r in metering.anchored_ceiling(spark.createDataFrame(rows, "call_id long, bucket string, visitor string, at_ms long"), 3, 3_600_000 * 8, 40).collect()}
    for bucket in "ab":
        total, opened, windows = 0, None, {}
        for k, own, visitor, t in rows:
            if own != bucket:
                continue
            if opened is None or t - opened > 86_400_000:
                total, opened = 0, t
            if total >= 40:
                expected = (False, 0)
            elif visitor not in windows or t - windows[visitor][1] > 3_600_000 * 8:
                windows[visitor], total, expected = (1, t), total + 1, (True, 2)
            elif windows[visitor][0] >= 3:
                expected = (False, 0)
            else:
                n = windows[visitor][0] + 1
                windows[visitor], total, expected = (n, windows[visitor][1]), total + 1, (True, 3 - n)
            assert found[k] == expected


def test_last_judgement_counts(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, chunk_idx long, rank long")
    judged = spark.createDataFrame([(1, 10, 3, 1), (1, 10, 0, 2), (1, 11, 1, 1)], "query_id long, chunk_idx long, relevance int, at int")
    assert [r["chunk_idx"] for r in fusion.reranked(found, judged).orderBy("rank").collect()] == [11, 10]


def test_weight_of_equals_is_the_smallest(spark):
    per = spark.createDataFrame([("0.0", 1, 0.5), ("0.3", 1, 0.7), ("0.1", 1, 0.7), ("1.0", 2, 0.9)], "config string, query_id long, ndcg double")
    asked = spark.createDataFrame([(1, "direct"), (2, "lookup")], "query_id long, slice string")
    assert tuple(evaluation.chosen_weight(per, asked).first()) == (0.1, 0.7)


def archive(entries, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_archives_are_judged_unopened():
    plain = archive({"a.txt": b"x" * 1000, "b.txt": b"y" * 500}, b"note")
    report = uploads.archive_report(plain)
    assert (report["entries"], report["unpacked"]) == (2, 1500) and report["ratio"] > 1
    assert uploads.archive_report(b"no archive") is None and uploads.archive_report(b"") is None
    assert uploads.archive_report(plain[: len(plain) // 2]) is None
    assert uploads.archive_report(archive({"big": bytes(30_000_000)}))["unpacked"] == 30_000_000


def test_uploads_of_every_kind(spark):
    said = "Records are kept for seven years and shared with nobody. " * 8
    body = "".join(f"<w:p><w:r><w:t>{p} &amp; more</w:t></w:r></w:p>" for p in ("First", said))
    docx = archive({"word/document.xml": f"<w:document>{body}</w:document>".encode()})
    bomb = archive({"word/document.xml": bytes(30_000_000)})
    rows = [
        ("a.docx", "", docx), ("bomb.docx", "", bomb), ("b.txt", "", said.encode()), ("c.pdf", "", b"%PDF"), ("d.txt", "", b""), ("e.txt", "", b"short"), ("f.png", "image/png", b"x" * 300),
        ("g.txt", "", b"\xff\xfe" * 300), ("h.md", "", ("long " * 6000).encode()), ("i.docx", "", b"no archive at all"),
    ]
    found = {r["path"]: r for r in uploads.extract_uploads(spark.createDataFrame(rows, "path string, mime string, content binary")).collect()}
    assert {p: r["error"] for p, r in found.items()} == {
        "a.docx": None, "bomb.docx": "unreadable", "b.txt": None, "c.pdf": "unsupported", "d.txt": "empty", "e.txt": "too short", "f.png": "unsupported", "g.txt": "not text", "h.md": None, "i.docx": "unreadable",
    }
    assert found["a.docx"]["text"].startswith("First & more\nRecords") and found["b.txt"]["text"] == said.strip()
    assert found["h.md"]["truncated"] and len(found["h.md"]["text"]) == 24_000
    safe = {r["path"]: r["safe"] for r in uploads.inspect_archives(spark.createDataFrame(rows, "path string, mime string, content binary")).collect()}
    assert safe["a.docx"] and not safe["bomb.docx"] and not safe["b.txt"]


def test_sections_of_xml_and_articles(spark):
    p = "A paragraph that is long enough to count as the text of a section of the rules, twice over. "
    xml = f"""<DIV8 N="164.1" TYPE="SECTION"><HEAD>§ 164.1 Basis.</HEAD><P>{p}</P><P>Next &amp; <I>last</I>.</P></DIV8><DIV8 N="164.2"><P>short</P></DIV8><DIV8 N="164.3"><P>{p}</P></DIV8>
        <DIV9 N="App. A" TYPE="APPENDIX"><HD1>Table of Contents</HD1><P>{p * 2}</P><HD1>First part</HD1><P>{p * 2}</P><FP>End.</FP></DIV9>"""
    files = spark.createDataFrame([("45", xml), ("46", None)], "title string, xml string")
    found = {r["number"]: (r["heading"], r["text"]) for r in sections.xml_sections(files).collect()}
    assert found == {"164.1": ("§ 164.1 Basis.", f"{p.strip()}\nNext & last ."), "164.3": ("Section 164.3", p.strip())}
    parts = [(r["heading"], r["text"]) for r in sections.xml_appendices(files).collect()]
    assert parts == [("First part", f"{(p * 2).strip()}\nEnd.")]
    html = "".join(f'<div id="d1e.art_{k}"><p class="oj-ti-art">Article {k}</p><p class="oj-sti-art">Title {k}</p><p class="oj-normal">{p * 2}</p></div>' for k in (1, 2))
    articles = {r["article"]: (r["heading"], r["text"]) for r in sections.article_sections(spark.createDataFrame([(html,)], "html string"), "d1e").collect()}
    assert articles == {str(k): (f"Title {k}", (p * 2).strip()) for k in (1, 2)}


def test_sections_and_index_on_disk(spark, tmp_path):
    rows = [("GDPR", "Art. 5", "h", "s", "u", "text one"), ("HIPAA", "164", "h", "s", "u", "text\ntwo")]
    table = spark.createDataFrame(rows, sections.SECTION)
    sections.write_sections(table, f"{tmp_path}/sections")
    assert sorted(map(tuple, sections.read_sections(spark, f"{tmp_path}/sections/*").drop("framework").collect())) == sorted(r[1:] for r in rows)
    (tmp_path / "bad.jsonl").write_text('{"framework": "GDPR"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        sections.read_sections(spark, f"{tmp_path}/bad.jsonl").collect()
    chunks, meta = table.select("citation"), spark.createDataFrame([(2,)], "dimensions int")
    sections.write_index(chunks, spark.createDataFrame([(1, [1.0, 0.0])], "chunk_idx long, embedding array<float>"), meta, f"{tmp_path}/index")
    assert sections.read_index(spark, f"{tmp_path}/index")["vectors"].count() == 1
    sections.write_index(chunks, spark.createDataFrame([(1, [1.0])], "chunk_idx long, embedding array<float>"), meta, f"{tmp_path}/other")
    with pytest.raises(Exception, match="wrong size"):
        sections.read_index(spark, f"{tmp_path}/other")["vectors"].collect()


def test_health_and_spans(spark):
    chunks = spark.createDataFrame([(1, "a"), (1, "b")], "chunk_idx long, citation string")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_idx long, embedding array<float>")
    assert {r["check"]: r["ok"] for r in outcomes.health(chunks, vectors).collect()} == {"index": True, "ids": False, "dimensions": False, "vectors": False}
    events = spark.createDataFrame([("r", "x", "start", 5), ("r", "x", "error", 9), ("r", "y", "start", 6), ("q", "x", "end", 7)], "run_id string, name string, phase string, at_ms long")
    assert sorted(map(tuple, outcomes.paired_spans(events).collect()), key=str) == [("r", "x", 5, 4, True), ("r", "y", 6, None, False)]


def test_order_of_the_classifier(spark):
    said = spark.createDataFrame([(1, "GDPR", 70), (1, "FERPA", 90)], "document_id long, framework string, score int")
    named = spark.createDataFrame([(1, "FERPA", 1), (1, "GDPR", 2)], "document_id long, framework string, position int")
    assert [r["framework"] for r in outcomes.in_classifier_order(said, named).orderBy("place").collect()] == ["FERPA", "GDPR"]
    assert json.loads(json.dumps(outcomes.FAILURES)) and set(outcomes.FAILURES) == {k for k, _ in T.FAILURE_RULES} | {"unknown"}
