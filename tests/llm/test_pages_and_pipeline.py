"""Main texts of planted pages; the pipeline against its parts."""

from __future__ import annotations

import time

import pytest

import corpus_pipeline
from lodestone.llm import queries
from lodestone.llm.packing import pack
from lodestone.llm.pii import find_personal_data
from lodestone.llm.pages import ballots, extract, main_texts
from tests.llm.test_duplicates import components, simhash
from tests.llm.test_text_operators import base_spans, checked_packing

ARTICLE = "<p>The first paragraph of the story runs on for a good many words, so that it is plainly text.</p><p>A &amp; B agreed\n  on the second &lt;one&gt;.</p>"


def page(body: str) -> str:
    return (
        "<html><head><title>T</title><script>var a = '<p>no</p>';</script><style>p{}</style></head><body><header><a href='/'>Home</a></header>"
        f"<nav><ul><li><a href='/a'>Menu entry</a></li></ul></nav><div class='content'>{body}</div><aside>Related links</aside><footer>All rights reserved</footer></body></html>"
    )


TEXT = "The first paragraph of the story runs on for a good many words, so that it is plainly text. A & B agreed on the second <one>."


def test_main_text_without_its_surroundings(spark):
    rows = [(k, f"https://h.example/{k}", page(ARTICLE), "clash") for k in range(5)]
    rows += [(5, None, page(ARTICLE), "x"), (6, "https://h.example/6", None, "x"), (7, "https://h.example/7", "", "x"), (8, "nonsense", "<p>unclosed <b>bold", "x"), (0, "https://h.example/0", page(ARTICLE), "x")]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()
    assert len(found) == len(rows)
    said = {r["page_id"]: r["text"] for r in found}
    assert [said[k] for k in range(6)] == [TEXT] * 6
    assert said[6] == said[7] == "" and said[8] == "unclosed bold"
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_every_page_has_a_row(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    rows = queries.op10_html_consensus(spark, tables).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(r["page_id"] for r in pages.select("page_id").collect())
    assert all(r["text"] == " ".join(r["text"].split()) and r["n_chars"] == len(r["text"]) for r in rows)


def hidden(text, spans):
    """text with each span (place, start, end, kind, base) as its kind in brackets."""
    out, at = [], 0
    for _, start, end, kind, _ in sorted(spans, key=lambda s: (s[1], s[2], s[3])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def test_pipeline_of_clashing_columns(spark, tables):
    """Columns named as the operators' own go through unchanged; an id with two texts loses only the copy."""
    rows = [(1, "A story of one thing.", "en"), (2, "a STORY of one thing.", None), (1, "Quite another text, mail a@b.org please.", "en"), (None, "Without an id 10.0.0.1", None), (5, None, "en")]
    schema = "doc_id long, text string, lang string, n_chars long, score int, lang_pred string, found int, spans string, row string, text_sha256 string, _row int"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z", "s", 4) for r in rows], schema)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, tables), name)
        assert docs.schema.simpleString() == f"struct<{schema.replace(', ', ',').replace(' long', ':bigint').replace(' string', ':string').replace(' int', ':int')}>"
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in docs.collect())) == [
        (0, "Without an id [IP]"), (1, "Quite another text, mail [EMAIL] please."), (2, "a STORY of one thing."),
    ]
    assert {tuple(r)[4:] for r in docs.collect()} == {(2, "x", 3, "y", "z", "s", 4)}


def test_pipeline_stage_by_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = dict(before)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, tables), name)
        assert docs.columns == columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language":
            expected = {d: t for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_copies":
            last = {}
            for d in sorted(expected):
                last[(expected[d] or "").lower()] = d
            expected = {d: expected[d] for d in last.values()}
        elif name == "near_copies":
            prints = {d: simhash(t) for d, t in expected.items()}
            ids = sorted(prints)
            links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
            expected = {d: expected[d] for d, root in components(ids, links).items() if d == root}
        elif name == "personal_data":
            table = spark.createDataFrame(list(expected.items()), "doc_id long, text string")
            spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in find_personal_data(table).select("doc_id", "spans").collect()}
            for d, t in expected.items():
                found = [(s[-2], s[1], s[2]) for s in spans[d] if s[-1]]
                assert found == base_spans(t or "")
            assert sum(len(s) for s in spans.values()) > 0
            expected = {d: hidden(t, spans[d]) for d, t in expected.items()}
            assert not any(base_spans(t or "") for t in expected.values())
        assert kept == expected, name
    rows = corpus_pipeline.run(spark, tables).collect()
    checked_packing(rows, expected)


def test_pipeline_of_nothing(spark, tables):
    none = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, none, tables).count() == 0
    assert pack(none, queries.vocabulary("byte_bpe_50k.json")).count() == 0


STORY = "".join(f"<p>Paragraph {k} of the long story has quite a number of words, as a story has.</p>" for k in range(12))


def test_pages_of_a_second_template(spark):
    card = "<article><p>A card that tells of another page.</p></article>"
    rows = [(k, f"https://h.example/{k}", f"<html><body><article>{STORY}</article></body></html>") for k in range(6)]
    rows += [(6, "https://h.example/6", f"<html><body><div class='story'>{STORY}</div>{card}</body></html>")]
    rows += [(7 + k, None, f"<html><body><article>{STORY}</article></body></html>") for k in range(3)]
    rows += [(10, "nonsense", f"<html><body><div class='story'>{STORY}</div>{card}</body></html>")]
    found = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = STORY.replace("<p>", "").replace("</p>", " ").strip()
    assert {r["page_id"]: r["text"] for r in found} == dict.fromkeys(range(11), text)


def test_blocks_inside_an_article():
    body = "<div class='article-header'>Title</div><div class='share-price'>Price 12</div><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p>"
    junk = "<div class='share-buttons'>Share this</div><div id='comments'>First!</div>"
    assert extract(f"<html><body><article>{body}{junk}<p>{ARTICLE}</p></article></body></html>", None) == f"Title Price 12 Let x=1 hold. {TEXT}"


HEADER = "<header class='top'><a href='/'>Home</a></header><nav><ul><li><a href='/a'>Menu entry</a></ul></nav>"
LAST = "<aside>Related links and more of them</aside><footer>All rights reserved by the owner</footer>"
PLAIN = STORY.replace("<p>", "").replace("</p>", " ").strip()
LEAD = "This is the lead of the story, which is a long enough sentence to be running text for sure."


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        (f"<div class='layout no-sidebar'>{STORY}</div>", PLAIN),
        (f"<article class='post comments-open'>{STORY}</article>", PLAIN),
        (f"<div class='content-sidebar-wrap'><div class='content'>{STORY}</div></div>", PLAIN),
        (f"<form id='whole-page'><div class='content'>{STORY}</div></form>", PLAIN),
        (f"<article>{STORY}<table class='side-by-side'><tr><td>One<td>Two</table></article>", f"{PLAIN} One Two"),
        (f"<article>{STORY}<p class='social-history'>Social</p><section id='related-work'>Work</section></article>", f"{PLAIN} Social Work"),
        (f"<div class='post'><div class='entry-header'><h1>Head</h1></div>{STORY}</div>", f"Head {PLAIN}"),
        (f"<div class='wrap'><div class='lead'><p>{LEAD}</p></div><div class='rest'>{STORY}</div></div>", f"{LEAD} {PLAIN}"),
        (f"<article>{STORY}</article><section id='comments'>{STORY}{STORY}</section>", PLAIN),
        (f"<div class='post'>{STORY}</div><div class='comment-list'>{STORY}<article class='comment'>{STORY}</article></div>", PLAIN),
        (f"<article><h1>H</h1><p>{LEAD}</p><div class='a'><div class='b'>{STORY}</div></div><div class='share-buttons'>Share</div></article>", f"H {LEAD} {PLAIN}"),
        (f"<h1>H</h1><div class='b'>{STORY}</div><div class='cookie-notice'><p>{LEAD}</p></div><div class='left-sidebar'><p>{LEAD}</p></div>", f"H {PLAIN}"),
        (f"<article>{STORY}<form><p>{LEAD}</p></form><div class='advert'><p>{LEAD}</p></div><div class='notice'>{LEAD}</div></article>", PLAIN),
    ],
)
def test_templates(body, expected):
    whole = f"<html><body>{HEADER}{body}{LAST}</body></html>"
    assert extract(whole, None) == expected
    (path, _), *_ = sorted(ballots(whole), key=lambda b: -b[1])
    assert extract(whole, path) == expected


def test_two_hosts_and_two_templates_each(spark):
    """Hosts vote for themselves; few hosts are broadcast, many are joined with salted keys."""
    kinds = [f"<div class='lead'><p>{LEAD}</p></div><div class='rest'>{STORY}</div>", f"<div class='box'><p>{LEAD}</p>{STORY}</div>", f"<main><div>{STORY}</div></main>"]
    texts = [f"{LEAD} {PLAIN}", f"{LEAD} {PLAIN}", PLAIN]
    rows = [(k, f"https://h{k % 2}.example/{k}", f"<html><body>{HEADER}{kinds[(k % 2) + (k % 7 == 0)]}{LAST}</body></html>") for k in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    expected = {k: texts[(k % 2) + (k % 7 == 0)] for k in range(40)}
    for hosts in (10, 1):
        assert {r["page_id"]: r["text"] for r in main_texts(table, hosts).collect()} == expected


@pytest.mark.parametrize(
    "page",
    ["<a " * 100_000, "<div>" * 50_000, "<p>" + "<b>" * 20_000 + "<hr>" * 20_000, "<ul><li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<!" * 100_000,
     "<div>" * 20_000 + "</foo>" * 20_000, "<a x='\"" * 100_000, "<script>" * 100_000, "<div class='k'>" + "<div class='j'>some text</div>" * 20_000, "</" * 100_000],
)
def test_broken_pages_end_soon(page):
    start = time.process_time()
    extract(page, None)
    ballots(page)
    assert time.process_time() - start < 20


def test_language_stage_without_any_language(spark, tables):
    rows = [(1, "some text", None), (2, "12 !", None), (3, None, None), (4, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, tables).collect()
    assert {r["doc_id"]: r["lang"] for r in kept} == {1: "und", 4: "und"}
