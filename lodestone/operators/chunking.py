"""Chunks of sections: paragraphs packed up to a target, with trailing units carried over.

All steps are loops over the units of one section, in batches of sections inside the tasks, so
chunking needs no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodestone.functions.text import TOKENS_PER_WORD, chunk_id, rounded

TARGET, OVERLAP, LEAST = 320, 64, 32
# The configurations that a sweep compares.
SWEEP = ((160, 32), (320, 64), (320, 0), (640, 128))
#: White space in the Unicode sense, as the column expressions have it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD, _EDGES = re.compile(f"[^{_SPACE}]+"), re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$")
_SENTENCES = re.compile(f"(?<=[.;:])[{_SPACE}]+")


def _odd(text: str) -> bool:
    """Whether text has a character that Python takes for white space and the column expressions don't."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def _n_words(text: str, odd: bool) -> int:
    return len(_WORD.findall(text)) if odd else len(text.split())


def tokens_of(text: str) -> int:
    """The estimate of estimated_tokens()."""
    return math.ceil(_n_words(text, _odd(text)) * TOKENS_PER_WORD)


def _paragraphs(text: str) -> list[tuple[str, int, list]]:
    """Paragraphs, trimmed and not empty, with their words, and room for their sentences, which are looked for once."""
    odd = _odd(text)
    return [(p, _n_words(p, odd), []) for p in (_EDGES.sub("", p) if odd else p.strip() for p in text.split("\n")) if p]


def _counted(paragraphs: list[tuple[str, int, list]], target: int) -> list[tuple[str, int]]:
    """units() with the words of each."""
    out: list[tuple[str, int]] = []
    for paragraph, n, sentences in paragraphs:
        if math.ceil(n * TOKENS_PER_WORD) <= target:
            out.append((paragraph, n))
            continue
        if not sentences:
            odd = _odd(paragraph)
            sentences += [(s, _n_words(s, odd)) for s in _SENTENCES.split(paragraph)]
        run, words = [], 0
        for sentence, more in sentences:
            if any(run) and math.ceil((words + more) * TOKENS_PER_WORD) > target:
                out.append((" ".join(run), words))
                run, words = [], 0
            if sentence or run:
                run.append(sentence)
                words += more
        if any(run):
            out.append((" ".join(run), words))
    return out


def units(text: str, target: int = TARGET) -> list[str]:
    """Paragraphs, trimmed and not empty; those over target as runs of whole sentences of at most target tokens, where possible."""
    return [u for u, _ in _counted(_paragraphs(text), target)]


def _spans(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    out, first, used = [], 0, 0
    for at, size in enumerate(sizes):
        if first < at and used + size > target:
            out.append((first, at))
            start, carried = at, 0
            while start > first and carried + sizes[start - 1] <= overlap:
                start -= 1
                carried += sizes[start]
            first, used = start, carried
        used += size
    if sizes:
        out.append((first, len(sizes)))
    return out


def bodies(listed: list[str], target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Units packed up to target; the next body starts with the last units that fit into overlap."""
    return ["\n".join(listed[a:b]) for a, b in _spans([tokens_of(u) for u in listed], target, overlap)]


def _chunked(paragraphs: list[tuple[str, int, list]], target: int, overlap: int, least: int) -> list[tuple[list[str], int]]:
    """Units and tokens of the bodies that stay. Line ends part words, so a body has the words of its units."""
    listed = _counted(paragraphs, target)
    spans = _spans([math.ceil(n * TOKENS_PER_WORD) for _, n in listed], target, overlap)
    every = [([u for u, _ in listed[a:b]], math.ceil(sum(n for _, n in listed[a:b]) * TOKENS_PER_WORD)) for a, b in spans]
    return [b for b in every if b[1] >= least] or every[:1]


def chunk_ranges(text: str, configs: tuple[tuple[int, int], ...] = SWEEP, least: int = LEAST) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """The pieces of a text, in order, and for each configuration (target, overlap) the pieces from and to which its chunks go.

    A piece is a paragraph, or a sentence of one that a configuration parts. Chunks are those of
    chunk_sections(): a unit is a run of pieces, a body a run of units.
    """
    shortest, odd, pieces, listed = min(t for t, _ in configs), _odd(text), [], []
    for paragraph, n, _ in _paragraphs(text):
        parts = [paragraph] if math.ceil(n * TOKENS_PER_WORD) <= shortest else _SENTENCES.split(paragraph)
        listed.append((n, len(pieces), [_n_words(p, odd) for p in parts] if len(parts) > 1 else [n]))
        pieces += parts
    out = []
    for target, overlap in configs:
        found: list[tuple[int, int, int]] = []
        for n, first, words in listed:
            if len(words) == 1 or math.ceil(n * TOKENS_PER_WORD) <= target:
                found.append((first, first + len(words), n))
                continue
            start, run = -1, 0
            for at, more in enumerate(words, first):
                if start >= 0 and math.ceil((run + more) * TOKENS_PER_WORD) > target:
                    found.append((start, at, run))
                    start, run = -1, 0
                if start >= 0 or pieces[at]:
                    start, run = start if start >= 0 else at, run + more
            if start >= 0:
                found.append((start, first + len(words), run))
        spans = _spans([math.ceil(n * TOKENS_PER_WORD) for _, _, n in found], target, overlap)
        every = [((found[a][0], found[b - 1][1]), math.ceil(sum(n for _, _, n in found[a:b]) * TOKENS_PER_WORD)) for a, b in spans]
        out.append([r for r, tokens in every if tokens >= least] or [r for r, _ in every[:1]])
    return pieces, out


def chunk_sections(sections: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """id, the section's columns, chunk text, tokens, ordinal, ordinal_of.

    sections: framework, citation, heading, text and others. Bodies under least tokens are
    dropped if the section has a longer one, before ordinals are given; without a longer one its
    first body stays. A null or blank text has no chunks.
    """
    others = [f for f in sections.schema.fields if f.name not in ("text", "tokens", "ordinal", "ordinal_of")]
    names = [f.name for f in others]
    schema = StructType([*others, StructField("text", StringType()), StructField("tokens", IntegerType()), StructField("ordinal", IntegerType()), StructField("ordinal_of", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                row, text, tokens, ordinal, of = [], [], [], [], []
                for k, value in enumerate(batch.column("text").to_pylist()):
                    kept = _chunked(_paragraphs(value or ""), target, overlap, least)
                    row += [k] * len(kept)
                    text += ["\n".join(b) for b, _ in kept]
                    tokens += [n for _, n in kept]
                    ordinal += range(len(kept))
                    of += [len(kept)] * len(kept)
                base = batch.select(names).take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([*base.columns, pa.array(text, pa.string()), *(pa.array(x, pa.int32()) for x in (tokens, ordinal, of))], names=[*names, "text", "tokens", "ordinal", "ordinal_of"])

    out = sections.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(chunk_id(F.col("framework"), F.col("citation"), F.col("ordinal")).alias("id"), *names, "text", "tokens", "ordinal", "ordinal_of")


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """id, n of ids that more than one chunk has; a build with any fails."""
    return chunks.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def picks(values: Column) -> list[Column]:
    """min, median, p95 and max as elements of the sorted list: the upper median, no interpolation."""
    ordered, n = F.sort_array(values), F.size(values)
    at = {"min": F.lit(0), "median": F.floor(n / 2).cast("int"), "p95": F.least(n - 1, F.floor(n * 0.95).cast("int")), "max": n - 1}
    return [F.get(ordered, place).alias(f"{name}_tokens") for name, place in at.items()]


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks and picks of tokens. Counts by size first, so what is gathered is bounded
    by the number of different sizes, and picks from running counts."""
    sizes = chunks.groupBy("tokens").agg(F.count("*").alias("n"))
    listed = sizes.agg(F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("sizes"))

    def pick(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("found"))
        return F.aggregate(
            "sizes", start, lambda a, s: F.struct((a["seen"] + s["n"]).alias("seen"), F.when(a["found"].isNull() & (a["seen"] + s["n"] > place), s["tokens"]).otherwise(a["found"]).alias("found"))
        )["found"]

    n = F.col("n_chunks")
    return listed.select(
        "n_chunks", pick(F.lit(0)).alias("min_tokens"), pick(F.floor(n / 2)).alias("median_tokens"),
        pick(F.least(n - 1, F.floor(n * 0.95))).alias("p95_tokens"), pick(n - 1).alias("max_tokens"),
    )


def swept(sections: DataFrame, configs: tuple[tuple[int, int], ...] = SWEEP, least: int = LEAST, *, texts: bool = True) -> DataFrame:
    """config (its number), chunk_idx, ordinal, tokens and, with texts, text of the chunks of sections (chunk_idx, text)
    in all configurations (target, overlap), from one reading of each text."""
    kind = dict(sections.dtypes)["chunk_idx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            row, config, ordinal, tokens, text = [], [], [], [], []
            for k, value in enumerate(batch.column("text").to_pylist()):
                paragraphs = _paragraphs(value or "")
                for c, (target, overlap) in enumerate(configs):
                    kept = _chunked(paragraphs, target, overlap, least)
                    row += [k] * len(kept)
                    config += [c] * len(kept)
                    ordinal += range(len(kept))
                    tokens += [n for _, n in kept]
                    text += ["\n".join(b) for b, _ in kept] if texts else []
            numbers = [pa.array(x, pa.int32()) for x in (config, ordinal, tokens)]
            own = batch.column("chunk_idx").take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([own, *numbers, *([pa.array(text, pa.string())] if texts else [])], names=["chunk_idx", "config", "ordinal", "tokens", *(["text"] if texts else [])])

    return sections.select("chunk_idx", F.col("text").cast("string").alias("text")).mapInArrow(run, f"chunk_idx {kind}, config int, ordinal int, tokens int{', text string' if texts else ''}")


def chunk_size_sweep(sections: DataFrame, configs: tuple[tuple[int, int], ...] = SWEEP) -> DataFrame:
    """target, overlap, n_chunks, avg_tokens for each configuration; without chunks avg_tokens is null."""
    some = [F.col("config") == c for c in range(len(configs))]
    counts = swept(sections, configs, texts=False).agg(*[x for c, own in enumerate(some) for x in (F.count_if(own).alias(f"n{c}"), F.avg(F.when(own, F.col("tokens"))).alias(f"t{c}"))])
    rows = [F.struct(F.lit(t).alias("target"), F.lit(o).alias("overlap"), F.col(f"n{c}").alias("n_chunks"), rounded(F.col(f"t{c}")).alias("avg_tokens")) for c, (t, o) in enumerate(configs)]
    return counts.select(F.inline(F.array(*rows)))
