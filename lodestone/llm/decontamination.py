"""Benchmark passages in documents: one Aho-Corasick automaton over the words of all test items.

Texts are normalised to words; every window of consecutive words of an item is a key of the
automaton, which reads each document once. Hits are runs of words, given back as places in the
original text.

The windows of a test set go to every task. They are read in blocks of BLOCK_WORDS windows at
most, so a task's automaton has a bounded size; a test set of several blocks takes a reading of
the documents for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage

WINDOW = 10
#: Windows of one automaton, ten nodes of some 50 bytes each.
BLOCK_WORDS = 200_000
_ROWS = 256
#: Digits, lower-cased ASCII letters and everything beyond ASCII are parts of words; all else is a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict = {}


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORD_BYTES).split()


def _windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        yield from (tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def _blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[dict[tuple[bytes, ...], list[str | None]]]:
    """Windows with the ids of their items, in blocks; rows of benchmark come to the driver a partition at a time."""
    block: dict[tuple[bytes, ...], list[str | None]] = {}
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        for window in _windows(_words((row[1] or "").encode()), size):
            block.setdefault(window, []).append(row[0])
            if len(block) >= most:
                yield block
                block = {}
    yield block


def _automaton(name: str, broadcast):
    """(numbers of words, automaton, items of each key), built once for each worker; one of them is kept."""
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        number: dict[bytes, int] = {}
        automaton, items = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), []
        for window, found in broadcast.value.items():
            key = tuple(number.setdefault(w, len(number) + 1) for w in window)
            automaton.add_word(key, (len(key), len(items)))
            items.append({i for i in found if i is not None})
        if items:
            automaton.make_automaton()
        _BUILT[name] = number, automaton, items
    return _BUILT[name]


def _spans(raw: bytes, first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Places in code points of runs of words, from the first word's start to the last word's end."""
    data = np.frombuffer(raw.translate(_WORD_BYTES), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [{"start": s, "end": e} for s, e in zip(points[edge[::2][first]].tolist(), points[edge[1::2][last - 1]].tolist(), strict=True)]


def _scan(broadcast):
    name = uuid.uuid4().hex
    run_type, span_type = pa.struct([("first", pa.int64()), ("last", pa.int64())]), pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, automaton, items = _automaton(name, broadcast)
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            n_words, n_hit, runs, named, spans = [], [], [], [], []
            for raw, old, known in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = _words(raw or b"")
                n_words.append(len(words))
                keys = {}
                if items and words:
                    for end, (length, key) in automaton.iter(tuple(map(number.get, words, repeat(0)))):
                        keys.setdefault(key, []).append((end + 1 - length, end + 1))
                if not keys:  # as it came
                    first, last = (np.array([r[x] for r in old], dtype=np.int64) for x in ("first", "last"))
                else:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    places = np.array([p for found in keys.values() for p in found] + [(r["first"], r["last"]) for r in old])
                    np.add.at(change, places[:, 0], 1)
                    np.add.at(change, places[:, 1], -1)
                    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                    edge = np.flatnonzero(hit[1:] != hit[:-1])
                    first, last = edge[::2], edge[1::2]
                    known = sorted(set(known).union(*(items[k] for k in keys)))
                n_hit.append(int((last - first).sum()))
                runs.append([{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                named.append(known)
                spans.append(_spans(raw, first, last) if len(first) else [])
            made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(named, pa.list_(pa.string())), pa.array(spans, pa.list_(span_type))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *made], names=["doc_id", "text", "n_words", "n_hit", "runs", "items", "spans"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans for every row of documents (doc_id, text).

    A window is so many consecutive words of an item of benchmark (item_id, text); an item of
    fewer words, but not none, is one window. n_hit counts the document's words inside any
    occurrence of a window, items are the ids of the items with such windows as sorted strings,
    spans the runs of hit words as places in the original text (code points, end exclusive).

    Null texts have no words, and items without words no windows. An item whose id is null hits
    words and is not named; items that share an id are one. Rows that are repeated are judged one
    by one, null doc_ids stay, other columns are ignored, and empty tables give no hits or no rows.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.expr("cast(array() as array<struct<first: long, last: long>>)").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = "doc_id long, text string, n_words long, n_hit long, runs array<struct<first: long, last: long>>, items array<string>, spans array<struct<start: long, end: long>>"
    found = None
    for windows in _blocks(benchmark, window, block):
        if found is not None:
            rows = stage(found, "scanned")
        found = rows.select("doc_id", "text", "runs", "items").mapInArrow(_scan(documents.sparkSession.sparkContext.broadcast(windows)), schema)
    return found.select("doc_id", "n_words", "n_hit", "items", "spans")
