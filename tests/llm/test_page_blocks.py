"""Main texts of generated pages whose text is known: blocks of many names in, beside and around the article."""

from __future__ import annotations

import random

import pytest

from lodestone.llm.pages import ballots, extract, main_texts

STORY = [f"Paragraph {k} of the story tells what happened on that day, and it goes on for long enough to be plainly prose." for k in range(4)]
BODY = "".join(f"<p>{t}</p>" for t in STORY)
TEXT = " ".join(STORY)

TALK = "<ol><li><b>Ann</b> on May 3 <p>I quite agree with what was said here, thank you for this fine piece of writing.</p></li><li><b>Bob</b> on May 4 <p>I don't, and I will tell you at some length why that is so in my opinion.</p></li></ol>"
LINKS = "<ul><li><a href='/a'>One more page</a></li><li><a href='/b'>And another one</a></li></ul>"
ADVERT = "<p>Buy our fine goods today, they are cheap and last long.</p><a href='/buy'>Buy now</a>"
COMMENTS = "disqus_thread post-comments article-comments entry-comments blog-comments story-comments comment-thread user-responses discussion".split()
ADVERTS = "article-ad inline-ad adsbygoogle post-advert".split()
OTHERS = "article-sidebar post-footer article-footer post-navigation breadcrumb-trail post-related article-share post-newsletter".split()
BLOCKS = [(n, TALK) for n in COMMENTS] + [(n, ADVERT) for n in ADVERTS] + [(n, LINKS) for n in OTHERS] + [("author-bio", "<p>Ann writes about rivers and lives by one.</p>")]


@pytest.mark.parametrize(("name", "inner"), BLOCKS)
def test_blocks_that_are_no_article(name, inner):
    for mark in (f'class="{name}"', f'id="{name}"'):
        block = f"<div {mark}>{inner}</div>"
        pages = {
            "inside": f"<body><div class='post'>{BODY}{block}</div></body>",
            "beside": f"<body><div class='page'><div class='post'>{BODY}</div>{block}</div></body>",
            "within": f"<body><article><div class='text'>{BODY}</div>{block}</article></body>",
            "between": f"<body><article><p>{STORY[0]}</p><p>{STORY[1]}</p>{block}<p>{STORY[2]}</p><p>{STORY[3]}</p></article></body>",
        }
        assert {where: extract(page, None) for where, page in pages.items()} == dict.fromkeys(pages, TEXT)


def test_more_comments_than_article():
    talk = f"<div class='post-comments'>{TALK * 9}</div>"
    assert extract(f"<body><div class='post'>{BODY}</div>{talk}</body>", None) == TEXT
    assert extract(f"<body><article>{BODY}{talk}</article></body>", None) == TEXT


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-comments", "post-notice", "comments-open", "side-by-side", "share-price", "lunch-menu", "cookie-recipe", "right-to-respond"])
def test_articles_of_suspicious_names(name):
    head = "<h1>What happened</h1>"
    for page in (
        f"<body><div class='{name}'>{head}{BODY}</div></body>", f"<body class='{name}'><div class='post'>{head}{BODY}</div></body>", f"<body><article class='post {name}'>{head}{BODY}</article></body>",
        f"<body><nav>Menu</nav><div class='{name}'><article>{head}{BODY}</article></div></body>",
    ):
        assert extract(page, None) == "What happened " + TEXT
    if name in ("share-price", "lunch-menu"):  # a part of the article that is neither links nor a few words
        assert extract(f"<body><article>{BODY}<div class='{name}'><p>{STORY[0]} Once more.</p></div></article></body>", None) == f"{TEXT} {STORY[0]} Once more."


def test_short_leads_and_tails():
    col = f"<div class='col'><div class='t1'><h2>What happened</h2><p>A short lead.</p></div><div class='t2'>{BODY}</div><div class='t3'><p>The end.</p></div></div>"
    expected = f"What happened A short lead. {TEXT} The end."
    assert extract(f"<body><nav>Menu</nav>{col}<footer>Foot</footer></body>", None) == expected
    assert extract(f"<body><div class='wrap'>{col}<div class='bar'><a href='/'>Home</a> <a href='/x'>More</a></div></div></body>", None) == expected
    nested = f"<div class='lead'><p>A short lead.</p></div><div class='rest'><div class='inner'>{BODY}</div></div><h3>Later</h3><p>The end.</p>"
    assert extract(f"<body><div class='story'>{nested}</div></body>", None) == f"A short lead. {TEXT} Later The end."
    links = "<div class='col2'><h3>Popular</h3><ul><li><a href='/1'>One page</a></li><li><a href='/2'>Two pages</a></li></ul></div>"
    assert extract(f"<body><div class='grid'><div class='col1'>{BODY}</div>{links}</div></body>", None) == TEXT


def generated(rng: random.Random) -> tuple[str, str]:
    """A page of random structure and its article's text."""
    parts, said = [], []
    for k in range(rng.randint(3, 9)):
        text = " ".join(rng.choice("river stone light evening walked over slowly toward the old bridge and waited".split()) for _ in range(rng.choice([3, 12, 40, 60]) if k else 50))
        kind = rng.choice(["p", "p", "p", "h2", "li", "quote"])
        parts.append({"p": f"<p>{text}.</p>", "h2": f"<h2>{text}</h2>", "li": f"<ul><li>{text}</li><li>and {text}</li></ul>", "quote": f"<blockquote><p>{text}</p></blockquote>"}[kind])
        said.append({"p": f"{text}.", "h2": text, "li": f"{text} and {text}", "quote": text}[kind])
        if rng.random() < 0.25:
            name, inner = rng.choice(BLOCKS)
            parts.append(f"<div class='{name}'>{inner}</div>")
    tag = rng.choice(["article", "main", "div class='entry'", "section class='story'"])
    body = f"<{tag}>{''.join(parts)}</{tag.split()[0]}>"
    around = [f"<div class='{n}'>{i}</div>" for n, i in rng.sample(BLOCKS, 3)]
    body = "".join([around[0], body, around[1]])
    if rng.random() < 0.5:
        body = f"<div class='wrapper'>{body}</div>"
    return f"<html><body><header><a href='/'>Home</a></header><nav>{LINKS}</nav>{body}{around[2]}<footer>All rights reserved</footer></body></html>", " ".join(said)


def test_generated_pages(spark):
    rng = random.Random(7)
    pages = [generated(rng) for _ in range(300)]
    rows = [(k, f"https://h{k % 9}.example/{k}", html) for k, (html, _) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    wrong = [k for k, (_, text) in enumerate(pages) if found[k] != text]
    assert not wrong, (len(wrong), pages[wrong[0]], found[wrong[0]])
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert all(ballots(html) for html, _ in pages)
