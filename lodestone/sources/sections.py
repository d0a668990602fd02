"""Sections from markup and from JSON lines; the index on disk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.text import indexed_text, stripped
from lodestone.functions.vectors import norm
from lodestone.operators.dense import int8_index
from lodestone.operators.lexical import TextIndex, read_text_index, write_text_index

SECTION = "framework string, citation string, heading string, source string, source_url string, text string"


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of all JSON lines files in path; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(SECTION).option("mode", "FAILFAST").json(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """JSON lines, a folder for each framework."""
    sections.write.mode("overwrite").partitionBy("framework").json(path)


def write_index(chunks: DataFrame, vectors: DataFrame, meta: DataFrame, path: str, quantised: bool = False, searched: bool = False) -> None:
    """chunks, vectors and meta as Parquet below path.

    quantised: the vectors as int8 steps with their scale. searched: with the postings of
    chunks (chunk_idx, framework, citation, heading, text), so that a search reads them and builds nothing.
    """
    for name, table in (("chunks", chunks), ("vectors", int8_index(vectors) if quantised else vectors), ("meta", meta)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    if searched:
        text = indexed_text(F.col("citation"), F.col("heading"), F.col("text"))
        write_text_index(chunks.withColumn("text", text), f"{path}/text", "framework")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index. A vector of another size than meta says, or of no length, fails the query."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "meta")}
    size = tables["vectors"].crossJoin(F.broadcast(tables["meta"].select("dimensions")))  # meta is one row
    numbers = F.col("embedding.q") if isinstance(tables["vectors"].schema["embedding"].dataType, StructType) else F.col("embedding")
    good = (F.size(numbers) == F.col("dimensions")) & (norm(numbers) > 0)
    fault = F.assert_true(good, F.lit("a vector of the index has the wrong size or no length")).isNull()
    tables["vectors"] = size.filter(fault).drop("dimensions")
    return tables


def read_postings(spark: SparkSession, path: str) -> TextIndex:
    """The postings of an index that was written with searched."""
    return read_text_index(spark, f"{path}/text")


class _Outline(HTMLParser):
    """Markup as a flat list of starts (tag, attributes), ends (tag, None) and texts; names in lower case, references decoded."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.items: list[str | tuple[str, dict[str, str] | None]] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.items.append((tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        self.items.append((tag, None))

    def handle_data(self, data: str) -> None:
        self.items.append(data)

    def parts(self, opens: Callable[[str, dict[str, str]], str | None], blocks: Callable[[str, dict[str, str]], str | None]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        """(name of a part, its blocks) in order. opens tells the name of the part that a start begins, or "" where one ends; blocks the kind of a block."""
        name, found, block = None, [], None
        for item in self.items:
            if isinstance(item, str):
                if block:
                    block[2].append(item)
                continue
            tag, attributes = item
            if block and attributes is None and tag == block[0]:
                found.append((block[1], " ".join("".join(block[2]).split())))
                block = None
            elif block:
                block[2].append(" ")  # a tag inside a block separates words
            elif attributes is not None and (begun := opens(tag, attributes)):
                if name is not None:
                    yield name, found
                name, found = begun, []
            elif attributes is None and name is not None and opens(tag, {}) == "":
                yield name, found
                name, found = None, []
            elif attributes is not None and name is not None and (kind := blocks(tag, attributes)):
                block = (tag, kind, [])
        if name is not None:
            yield name, found


def _said(found: list[tuple[str, str]]) -> str:
    return "\n".join(text for kind, text in found if kind == "text" and text)


def _rows(files: DataFrame, column: str, names: list[str], schema: str, read: Callable[[str], list[tuple]]) -> DataFrame:
    """The rows that read finds in each file, beside the columns of names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*(row[n] for n in names), *found) for _, row in frame.iterrows() for found in read(row[column] or "")]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return files.select(*names, column).mapInPandas(run, schema)


def _division(tag: str) -> Callable[[str, dict[str, str]], str | None]:
    return lambda name, attributes: (attributes.get("n") or "") if name == tag else None


def xml_sections(files: DataFrame, least: int = 80) -> DataFrame:
    """title, number, heading, text from eCFR XML (title, xml): one row for each DIV8 with enough text."""

    def read(xml: str) -> list[tuple]:
        out = []
        for number, found in _Outline(xml).parts(_division("div8"), lambda tag, _: {"head": "heading", "p": "text"}.get(tag)):
            heading = next((t for k, t in found if k == "heading"), f"Section {number}")
            out.append((number, heading, _said(found)))
        return [r for r in out if len(r[2]) >= least]

    return _rows(files, "xml", ["title"], "title string, number string, heading string, text string", read)


def xml_appendices(files: DataFrame, least: int = 120) -> DataFrame:
    """title, number, heading, text: each DIV9 cut before its headings; tables of contents left out."""
    kinds = {"hd1": "heading", "p": "text", "fp": "text", "fp-1": "text", "fp-2": "text"}

    def read(xml: str) -> list[tuple]:
        out = []
        for number, found in _Outline(xml).parts(_division("div9"), lambda tag, _: kinds.get(tag)):
            pieces: list[tuple[str, list]] = [(number, [])]
            for kind, text in found:
                if kind == "heading":
                    pieces.append((text, []))
                else:
                    pieces[-1][1].append((kind, text))
            out += [(number, heading, _said(piece)) for heading, piece in pieces]
        return [r for r in out if len(r[2]) >= least and "table of contents" not in r[1].lower()]

    return _rows(files, "xml", ["title"], "title string, number string, heading string, text string", read)


def article_sections(files: DataFrame, prefix: str, least: int = 120) -> DataFrame:
    """article, heading, text from legal HTML (html): from each article's mark to the next; what stands before its heading is left out."""
    mark = f"{prefix}.art_"
    kinds = {"oj-sti-art": "heading", "oj-normal": "text"}

    def opens(tag: str, attributes: dict[str, str]) -> str | None:
        number = attributes.get("id", "").removeprefix(mark)
        return number if attributes.get("id", "").startswith(mark) and number.isdecimal() else None

    def blocks(tag: str, attributes: dict[str, str]) -> str | None:
        return next((kinds[c] for c in attributes.get("class", "").split() if c in kinds), None) if tag == "p" else None

    def read(html: str) -> list[tuple]:
        out = []
        for number, found in _Outline(html).parts(opens, blocks):
            at = next((k for k, b in enumerate(found) if b[0] == "heading"), None)
            heading = f"Article {number}" if at is None else found[at][1]
            out.append((number, heading, _said(found if at is None else found[at + 1 :])))
        return [r for r in out if len(r[2]) >= least]

    return _rows(files, "html", [], "article string, heading string, text string", read)


def page_sections(pages: DataFrame, least: int = 80) -> DataFrame:
    """page_id, para, text of the paragraphs of pages (page_id, html) with enough text, scripts and styles dropped.

    A paragraph may have attributes; it ends at its end tag or where the next one begins.
    """
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    listed = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?:</p>|(?=<p[\s>])|$)"), F.lit(1))).alias("para", "raw"))
    return listed.select("page_id", "para", stripped(F.col("raw")).alias("text")).filter(F.char_length("text") >= least)
