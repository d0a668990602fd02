"""Main text of web pages by consensus host paths.

Each page scores its containers by the text in them; the best ones vote, under their path of
tags and classes with digits left out, for their host. The winning path of a host is then used
to extract all its pages again, so one odd page does not decide alone what its article is. A
page where the path holds less than half of the text that counts in the page's own best
container, such as a page of another template, falls back on that container.

What is left out: elements that never hold an article (navigation, footers, asides, scripts and
so on), and elements whose class, id or role says that they are something else. A name that is
made of such words alone ("sidebar", "left-sidebar") is enough. Where such an element holds
nearly all of the page's text, or more than the rest and an article, a main element or a first
heading, its name is wrong and it stays. A name that only ends or begins so ("post-comments",
"disqus_thread", "article-ad", "has-sidebar") is a suspicion that the block itself decides: it
stays if it holds a first heading, an article or a main element, or most of the page's text with
nothing before it, and menus and share bars go only if they are links or a few words.

A chosen container that is no article or main element grows to the element around it as long as
what else stands there reads on as the article: paragraphs, headings, lists and blocks of them
with few links. Where something else stands there, only what reads so is added.

Pages are read in one pass and every later step is linear in the page, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import looked_up, stage

VOTES = 3
#: Winning paths are broadcast up to this many hosts (some 200 bytes each) and joined beyond.
BROADCAST_HOSTS = 50_000
#: Innermost steps that a path spells out; the steps before them are in its digest.
SPELLED = 12
#: Characters outside links that make a sibling running text, and that a wrongly named element holds at least.
PROSE, LEAST = 80, 200

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded".split()
)
_DROP = frozenset(
    "nav footer aside script style noscript template svg iframe button select option textarea input dialog menu object canvas audio video head title noembed noframes xmp annotation annotation-xml".split()
)
#: Last words of a name that make it suspicious, and first ones.
_LAST = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo banner breadcrumb breadcrumbs pagination pager toc sidebar widget widgets
    footer comment comments commentlist disqus replies responses reactions discussion discussions cookie cookies consent notice notices newsletter subscribe signup
    related recommended recommendations feedback bio nav navigation navbar menu submenu share sharing social""".split()
)
_FIRST = frozenset("disqus comment comments commentlist breadcrumb breadcrumbs adsbygoogle advert advertisement newsletter cookie cookies sidebar".split())
#: Those of them that may be read as something else: they go only if they are links or a few words.
_BARS = frozenset("nav navigation navbar menu submenu share sharing social pagination pager toc breadcrumb breadcrumbs".split())
_TALK = frozenset("comment comments commentlist disqus replies responses reactions discussion discussions".split())
#: What reads on as an article beside a container.
_PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words in a class or id that mark what isn't the article.
_MARKS = frozenset(
    """ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc sidebar side aside rail widget widgets
    footer foot masthead topbar comment comments commentlist disqus respond reply replies reactions cookie cookies consent
    gdpr notice notices notification notifications alert modal popup overlay newsletter subscribe subscription signup login share sharing social
    related recommended recommendations search form feedback skip hidden responses discussion discussions bio""".split()
)
#: What else can stand in such a name: share-buttons and left-sidebar go, share-price and comments-open stay.
_PARTS = frozenset(
    """area articles bar block body bottom box btn button buttons container content desktop div entries global google gpt icon icons inner
    item items left links list main media mobile outer page panel posts primary reader readers right row secondary section site slot stories
    text title top unit user users wrap wrapper x""".split()
)
#: A header of the page, not of its article.
_HEADER = frozenset("header site page global top main bar inner outer wrap wrapper container".split())
_CONTAINERS = frozenset("article main section div td body center blockquote form html".split())
#: An open p is closed by the start of one of these.
_P_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element among the values is closed by the start of the key, unless one of _SCOPES is opened in it.
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol menu dl table select".split())
_BOUNDS = _SCOPES | set(_ENDS_SAME)

#: Every alternative ends where the next < begins or the page ends at the latest, so nothing is read twice.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)(?:>|(?=<)|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?+""")
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in _RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_KEPT, _NAMED, _NEVER = 0, 1, 2


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty if it has none."""
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class _Node:
    """An element. drop: whether it stays, goes by its name, or never holds an article; step and digest:
    its own part of a path and the whole path; doubt: the word that makes its name suspicious; prose: whether a
    paragraph or a lower heading is in it; para, bound: the nearest open p, and what an item may close."""

    __slots__ = ("bound", "box", "children", "digest", "doubt", "drop", "links", "para", "parent", "prose", "score", "step", "tag", "text")

    def __init__(self, tag: str, parent: _Node | None, drop: int, step: str):
        self.tag, self.parent, self.drop, self.step = tag, parent, drop, step
        self.children: list[_Node | str] = []
        self.score, self.text, self.links, self.prose = 0.0, 0, 0, False
        self.doubt: str | None = None
        self.para = self if tag == "p" else parent.para if parent and tag in _INLINE else None
        self.bound = self if tag in _BOUNDS else parent.bound if parent else None
        self.box = parent if parent is None or parent.tag in _CONTAINERS else parent.box
        above = parent.digest if parent else 0
        self.digest = xxhash.xxh64_intdigest(f"{above:x}>{step}") if step else above


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _named(names: list[str], inside: bool) -> bool:
    """Whether a class or id says that this isn't the article; inside one, a header is part of it."""
    for name in names:
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & _MARKS and words <= _MARKS | _PARTS or "header" in words and words <= _HEADER and not inside:
            return True
    return False


def _doubted(names: list[str]) -> str | None:
    """The word for which a class or id is suspicious, if one is."""
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and (words[-1] in _LAST or words[0] in _FIRST):
            return words[-1] if words[-1] in _LAST else words[0]
    return None


def _drop(tag: str, attributes: dict[str, str], names: list[str], inside: bool) -> int:
    if tag in _DROP or tag == "header" and not inside:
        return _NEVER
    if tag in ("html", "body", "main"):
        return _KEPT
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    return _NAMED if tag == "form" or hidden or attributes.get("role", "").lower() in _ROLES or _named(names, inside) else _KEPT


def parse(page: str) -> _Node:
    """The tree of a page: elements and pieces of text, what isn't article marked as dropped."""
    root = node = _Node("", None, _KEPT, "")
    open_tags: dict[str, int] = {}
    at, end = 0, len(page)

    def close(upto: _Node) -> _Node:
        """Close all open elements up to and including this one."""
        up = node
        while True:
            open_tags[up.tag] -= 1
            if up is upto:
                return up.parent
            up = up.parent

    while at < end:
        found = _TOKEN.search(page, at)
        if found is None:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if open_tags.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            elif tag in ("p", "br"):  # an end tag of its own is an empty element
                node.children.append(_Node(tag, node, _KEPT, ""))
            continue
        if tag in _P_ENDS and node.para:
            node = close(node.para)
        elif tag in _ENDS_SAME:
            while node.bound and node.bound.tag in _ENDS_SAME[tag]:
                node = close(node.bound)
        attributes = _attributes(found[3])
        classes = attributes.get("class", "").split()
        inside = open_tags.get("article", 0) + open_tags.get("main", 0) > 0
        step = ""
        if tag in _CONTAINERS:
            step = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes} - {""})])
            if step == tag and attributes.get("id"):
                step += "#" + re.sub(r"\d+", "", attributes["id"])
        names = [*classes, *attributes.get("id", "").split()]
        child = _Node(tag, node, _drop(tag, attributes, names, inside), step)
        if child.drop == _KEPT and names and tag not in ("html", "body", "main"):
            child.doubt = _doubted(names)
        node.children.append(child)
        if tag in _RAW:
            closing = _CLOSE[tag].search(page, at)
            at = closing.end() if closing else end
        elif tag not in _VOID:  # a slash at the end means nothing on other elements
            node = child
            open_tags[tag] = open_tags.get(tag, 0) + 1
    _measure(root)
    return root


def _down(root: _Node) -> list[_Node]:
    """All elements that can hold article text, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(n for n in node.children if not isinstance(n, str) and n.drop != _NEVER)
    return out


def _measure(root: _Node) -> None:
    """Sizes and scores of all elements, without what is dropped in them; wrong names are taken back.

    text: characters that count, outside links; links: those inside. A container's score is the
    text right in it less its links, and less than the whole of what the containers in it have.
    """
    nodes = _down(root)

    def add() -> None:
        for node in nodes:
            node.text, node.links, node.score, node.prose = 0, 0, 0.0, False
        for node in reversed(nodes):
            size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
            node.text += size
            node.score += size
            if node.tag == "a":
                node.text, node.links = 0, node.text + node.links
                node.score = -node.links
            up = node.parent
            if up is not None and node.drop == _KEPT:
                up.text += node.text
                up.links += node.links
                up.prose = up.prose or node.prose or node.tag in ("p", "h2", "h3", "h4", "h5", "h6") and node.text > 0
                up.score += node.score * (1.0 if node.tag not in _CONTAINERS else 0.85 if node.tag == "section" else 0.6)

    add()
    named = [n for n in nodes if n.drop == _NAMED]
    doubted = [n for n in nodes if n.doubt]
    if named or doubted:
        heads = set()  # elements around an article, a main element or a first heading
        for node in nodes:
            if node.tag in ("article", "main", "h1") and node.drop == _KEPT and not node.doubt:
                up = node.parent
                while up is not None and up not in heads:
                    heads.add(up)
                    up = up.parent
    if doubted:
        before = _text_before(root)
        for node in doubted:
            bar = node.doubt in _BARS and node.links < node.text and node.text >= PROSE
            small = 2 * node.text <= root.text or before.get(node, 0) >= LEAST or node.doubt in _TALK and _repeats(node)
            if node not in heads and not bar and small:
                node.drop = _NAMED
        add()
    if named:
        best = max(named, key=lambda n: n.text)
        if best.text >= LEAST and best.text > (1 if best in heads else 4) * root.text:
            while best is not None:
                best.drop = _KEPT
                best = best.parent
            add()


def _text_before(root: _Node) -> dict[_Node, int]:
    """Characters outside links that stand before each suspicious element, those in suspicious ones not counted."""
    out, seen, stack = {}, 0, [(root, False)]
    while stack:
        node, linked = stack.pop()
        if isinstance(node, str):
            seen += 0 if linked else len(node.strip())
            continue
        if node.doubt:
            out[node] = seen
            stack.extend((n, True) for n in reversed(node.children) if isinstance(n, str) or n.drop == _KEPT)
        else:
            stack.extend((n, linked or node.tag == "a") for n in reversed(node.children) if isinstance(n, str) or n.drop == _KEPT)
    return out


def _repeats(node: _Node) -> bool:
    """Whether an element is a list of items of one kind, or holds a form."""
    while len(inner := [n for n in node.children if not isinstance(n, str) and n.tag in ("ol", "ul", "div", "section")]) == 1:
        node = inner[0]
    items = [(n.tag, n.step) for n in node.children if not isinstance(n, str) and n.tag in ("li", "div", "article", "section", "form")]
    return len(items) > len(set(items)) or any(tag == "form" for tag, _ in items)


def text_of(nodes: list[_Node]) -> str:
    """The texts of nodes in page order, blocks joined by one space."""
    out: list[str] = []
    stack: list[_Node | str] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(html.unescape(item) if "&" in item else item)
        elif item.drop == _KEPT:
            block = item.tag not in _INLINE
            if block:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(item.children))
    return " ".join("".join(out).split())


def _boxes(root: _Node) -> list[_Node]:
    """All containers that stay, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in _CONTAINERS:
            out.append(node)
        stack.extend(n for n in reversed(node.children) if not isinstance(n, str) and n.drop == _KEPT)
    return out


def _worth(node: _Node) -> float:
    return node.score * {"article": 2.0, "main": 1.5}.get(node.tag, 1.0)


def _whole(node: _Node) -> _Node:
    """The article around a container, or the main element if the container is most of it."""
    main, up = node, node
    while up is not None:
        if up.tag == "article":
            return up
        if up.tag == "main" and main is node and 2 * node.text >= up.text:
            main = up
        up = up.box
    return main


def _best(boxes: list[_Node], number: int) -> list[_Node]:
    """The best containers, best first; of equals the first in the page."""
    some = sorted((n for n in boxes if n.score > 0), key=lambda n: -_worth(n))[:number]
    return list(dict.fromkeys(map(_whole, some)))


def path_of(node: _Node) -> str:
    """The path of a container: a digest of all its steps, then the innermost ones in words."""
    steps, up = [], node
    while up is not None and len(steps) < SPELLED:
        steps.append(up.step)
        up = up.box
    return f"{node.digest:016x} {'>'.join(s for s in reversed(steps) if s)}"


def ballots(page: str, votes: int = VOTES) -> list[tuple[str, float]]:
    """(path, share of a vote) of the best containers of a page."""
    best = [n for n in _best(_boxes(parse(page)), votes) if n.score > 0]
    total = sum(map(_worth, best))
    out: dict[str, float] = {}
    for n in best:
        out[path_of(n)] = out.get(path_of(n), 0.0) + _worth(n) / total
    return list(out.items())


def _outermost(nodes: list[_Node]) -> list[_Node]:
    """nodes in page order, without those inside another one."""
    out: dict[_Node, bool] = {}
    inside: dict[_Node | None, bool] = {None: False}
    wanted = set(nodes)
    for node in nodes:
        trail, up = [], node.parent
        while up not in inside:
            trail.append(up)
            up = up.parent
        held = inside[up]
        for n in reversed(trail):
            held = held or n in wanted
            inside[n] = held
        if not held:
            out[node] = True
    return list(out)


def _reads_on(node: _Node, beside: _Node) -> bool:
    """Whether an element reads on as the article that stands beside it."""
    if 3 * node.links > node.text or not node.text:
        return False
    if node.tag in _PROSE_TAGS or node.tag in _INLINE:
        return True
    alike = node.tag == beside.tag and node.step == beside.step
    return node.tag in _CONTAINERS and node.prose and (alike or not node.links) or node.text >= PROSE


def _grown(node: _Node) -> _Node:
    """The widest element around a container where everything reads on as the article."""
    while node.parent is not None and node.tag not in ("article", "main") and node.parent.tag not in ("", "html", "body", "main", "article"):
        others = [n for n in node.parent.children if not isinstance(n, str) and n is not node and n.drop == _KEPT and n.text + n.links]
        if not all(_reads_on(n, node) for n in others):
            break
        node = node.parent
    return node


def _with_siblings(nodes: list[_Node]) -> list[_Node]:
    """nodes as wide as they read on and, beside each that is no article or main element, what reads on; in the body itself, running text and a first heading before it."""
    grown = _outermost(list(dict.fromkeys(map(_grown, nodes))))
    wanted, out, done = set(grown), [], set()
    for node in grown:
        if node.tag in ("article", "main") or node.parent is None:
            out.append(node)
        elif node.parent not in done:
            done.add(node.parent)
            before, bare = True, node.parent.tag in ("", "html", "body")
            for n in node.parent.children:
                if isinstance(n, str) or n.drop != _KEPT:
                    continue
                before = before and n not in wanted
                prose = n.text >= PROSE and n.text > 3 * n.links and n.tag not in ("ul", "ol", "table")
                if n in wanted or prose or n.tag == "h1" and before or not bare and _reads_on(n, node):
                    out.append(n)
    return list(dict.fromkeys(out))


def extract(page: str | None, path: str | None) -> str:
    """The main text of one page, given the winning path of its host."""
    root = parse(page or "")
    boxes = _boxes(root)
    best = _best(boxes, 1) or [root]
    chosen = _outermost([n for n in boxes if f"{n.digest:016x}" == path[:16]]) if path else []
    if 2 * sum(n.text for n in chosen) < best[0].text or not chosen:
        chosen = best
    return text_of(_with_siblings(chosen))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, str], float] = {}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            if not host:
                continue
            for path, share in ballots(page or ""):
                sums[host, path] = sums.get((host, path), 0.0) + share
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.float64())],
            names=["host", "path", "votes"],
        )


def _hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, hosts], names=[*batch.schema.names, "host"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that won among the pages of each host; ties go to the greater path."""
    votes = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    votes = votes.mapInArrow(_voted, "host string, path string, votes double")
    votes = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def main_texts(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null html counts as empty and gives an empty text, as does a page without any. A page with a
    null URL, or one without a host, goes by its own best container. Repeated rows stay repeated, other
    columns are ignored, an empty table gives an empty result. A tag that never ends ends where the
    next one begins.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = stage(host_paths(rows), "host-paths")
    named = rows.mapInArrow(_hosts, "page_id long, url string, html string, host string")
    joined = looked_up(named, winners, "host", "page_id", "left", broadcast_hosts)
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
