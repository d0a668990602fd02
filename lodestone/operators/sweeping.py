"""BM25 over the chunks of several configurations, without an index: texts are read once, and no posting is shuffled.

Each text is parted and its terms are looked for once; a chunk of any configuration is a run of
its pieces, so its counts are those between two places. What the queries' terms count in each
chunk is written as rows of numbers. A first reading of these adds up how many chunks have a term;
a second one scores chunks where they are, and a task sends k rows for each query and configuration.

Every task holds the queries, and k rows for each of them and each configuration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import term_of, terms
from lodestone.operators.chunking import LEAST, SWEEP, chunk_ranges
from lodestone.operators.lexical import _TERM, B, K1, _added
from lodestone.session import written

#: Texts that are counted at once, and rows that a task gathers before it keeps the best of them.
TEXTS, GATHERED = 256, 1 << 20
#: Raw words whose terms a task remembers.
REMEMBERED = 1 << 18
#: Numbers of what stands for no asked term: another one, and a stopword.
_OTHER, _NONE = -1, -2


@dataclass
class Asked:
    """Queries: ids, texts, numbers of their terms, and of those that every text has that holds the query word for word."""

    ids: list = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    terms: list[np.ndarray] = field(default_factory=list)
    inner: list[np.ndarray] = field(default_factory=list)
    number: dict[str, int] = field(default_factory=dict)


def asked_of(queries: DataFrame) -> Asked:
    """queries (query_id, query) with terms. What touches an end of the query may be a part of a word in a text, so it is no inner term."""
    run = "[a-z0-9.]+"
    inner = terms(F.regexp_replace(F.lower("query"), f"^{run}|{run}$", " "))
    rows = queries.filter("query is not null").select("query_id", "query", F.array_distinct(terms(F.col("query"))).alias("terms"), F.array_distinct(inner).alias("inner")).collect()
    out = Asked()
    for row in rows:
        numbers = [np.array([out.number.setdefault(t, len(out.number)) for t in row[c]], dtype=np.int64) for c in ("terms", "inner")]
        out.ids.append(row["query_id"])
        out.texts.append(row["query"])
        out.terms.append(numbers[0])
        out.inner.append(numbers[1])
    return out


class _Numbers(dict):
    """Numbers of raw words by their terms."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, raw: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        term = term_of(raw)
        self[raw] = found = _NONE if term is None else self.number.get(term, _OTHER)
        return found


def _within(code: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, term, count) of the asked terms, code at place in order, in each range of places."""
    low = np.searchsorted(place, first)
    n = np.searchsorted(place, end) - low
    own = np.repeat(np.arange(len(first)), n)
    at = np.arange(len(own)) + np.repeat(low - (np.cumsum(n) - n), n)
    keys, counts = np.unique(own * max(n_terms, 1) + code[at], return_counts=True)
    return keys // max(n_terms, 1), keys % max(n_terms, 1), counts


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes as the greatest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max())) if len(numbers) else np.uint8).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


COUNTED = "chunk_idx binary, n_chunks array<long>, n_terms binary, chunk binary, term binary, tf binary, n_found long, gold_query array<int>, gold_idx array<long>"


def counted(sections: DataFrame, asked, configs: tuple[tuple[int, int], ...] = SWEEP, least: int = LEAST) -> DataFrame:
    """What sections (chunk_idx, text) and their chunks count of asked (a broadcast of Asked), a row for some texts; chunks by configuration and id.

    A chunk's id is its section's and, in the last 20 bits, the ordinal. gold_query and gold_idx are
    the places of the queries and the sections that hold them word for word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Asked = asked.value
        numbers, n_terms = _Numbers(own.number), len(own.number)
        for batch in (b.slice(k, TEXTS) for b in batches for k in range(0, b.num_rows, TEXTS)):
            ids, texts = batch.column("chunk_idx").to_numpy(), [t or "" for t in batch.column("text").to_pylist()]
            raw: list[str] = []
            begun, of, config, ordinal, first, end, edges = [0], [], [], [], [], [], [0]
            for k, text in enumerate(texts):
                pieces, ranges = chunk_ranges(text, configs, least)
                base = len(begun) - 1
                for piece in pieces:
                    raw += _TERM.findall(piece.lower())
                    begun.append(len(raw))
                edges.append(len(raw))
                for c, spans in enumerate(ranges):
                    of += [k] * len(spans)
                    config += [c] * len(spans)
                    ordinal += range(len(spans))
                    first += [base + a for a, _ in spans]
                    end += [base + b for _, b in spans]
            code = np.fromiter(map(numbers.__getitem__, raw), np.int64, len(raw))
            place = np.flatnonzero(code >= 0)
            hits, counts = code[place], np.append(0, np.cumsum(code != _NONE))
            chunk = (ids[np.array(of, dtype=np.int64)].astype(np.int64) << 20) + np.array(ordinal, dtype=np.int64) if of else np.zeros(0, dtype=np.int64)
            order = np.lexsort((chunk, np.array(config)))
            start, stop = (np.array(begun)[np.array(x, dtype=np.int64)[order]] for x in (first, end))
            row, term, tf = _within(hits, place, start, stop, n_terms)
            section, holds, _ = _within(hits, place, np.array(edges[:-1]), np.array(edges[1:]), n_terms)
            by = np.argsort(holds, kind="stable")
            section, cuts = section[by], np.searchsorted(holds[by], np.arange(n_terms + 1))
            gold: list[tuple[int, int]] = []
            for q, (text, inner) in enumerate(zip(own.texts, own.inner, strict=True)):
                some = range(len(texts))
                if len(inner):
                    met = np.bincount(np.concatenate([section[cuts[t] : cuts[t + 1]] for t in inner]), minlength=len(texts))
                    some = np.flatnonzero(met == len(inner)).tolist()
                gold += [(q, int(ids[k])) for k in some if batch.column("text")[k].is_valid and text in texts[k]]
            blobs = [chunk[order].tobytes(), _small(counts[stop] - counts[start]), _small(row), _small(term), _small(tf)]
            chunks, n_chunks = pa.array([blobs[0]], pa.binary()), [np.bincount(np.array(config, dtype=np.int64), minlength=len(configs)).tolist()]
            lists = [pa.array([[x[c] for x in gold]], pa.list_(kind)) for c, kind in ((0, pa.int32()), (1, pa.int64()))]
            columns = [chunks, pa.array(n_chunks, pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs[1:]), pa.array([len(tf)], pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in COUNTED.split(", ")])

    rows = sections.select(F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, COUNTED), "counted")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Configuration and length of each chunk; chunk, term and count of each hit."""
    for r in batch.to_pylist():
        n = np.array(r["n_chunks"])
        yield np.repeat(np.arange(len(n)), n), _large(r["n_terms"], int(n.sum())), *(_large(r[c], r["n_found"]) for c in ("chunk", "term", "tf"))


def totals(rows: DataFrame, n_configs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of each configuration, their terms, and the chunks that have each asked term. A number for each configuration and term is all that is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_configs, n_terms + 2), dtype=np.int64)
        for batch in batches:
            for config, length, chunk, term, _ in _rows(batch):
                sums[:, 0] += np.bincount(config, minlength=n_configs)
                np.add.at(sums[:, 1], config, length)
                sums[:, 2:] += np.bincount(config[chunk] * n_terms + term, minlength=n_configs * n_terms).reshape(n_configs, n_terms)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "n"])

    out = np.zeros(n_configs * (n_terms + 2), dtype=np.int64)
    for row in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    out = out.reshape(n_configs, n_terms + 2)
    return out[:, 0], out[:, 1], out[:, 2:]


def gold_of(rows: DataFrame, queries: DataFrame, asked: Asked) -> DataFrame:
    """query_id, section of the sections that hold a query word for word."""
    names = rows.sparkSession.createDataFrame(list(enumerate(asked.ids)), f"query int, query_id {dict(queries.dtypes)['query_id']}")
    pairs = rows.select(F.inline(F.arrays_zip(F.col("gold_query").alias("query"), F.col("gold_idx").alias("section"))))
    return pairs.join(F.broadcast(names), "query").select("query_id", "section")


def best_chunks(rows: DataFrame, queries: DataFrame, asked, counts: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """config (its number), query_id, chunk_idx, score, rank of the k best chunks by BM25; ties go to the smaller chunk_idx."""
    n_chunks, lengths, df = counts
    idf = np.log(1 + (n_chunks[:, None] - df + 0.5) / (df + 0.5))
    mean = np.where(lengths > 0, lengths / np.maximum(n_chunks, 1), 1.0)
    n_configs, n_terms = df.shape

    def kept(config: np.ndarray, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((chunk, -score, query, config))
        config, query, chunk, score = (x[order] for x in (config, query, chunk, score))
        new = np.append(True, (config[1:] != config[:-1]) | (query[1:] != query[:-1]))[: len(config)]
        place = np.arange(len(config)) - np.maximum.accumulate(np.where(new, np.arange(len(config)), 0))
        return tuple(x[place < k] for x in (config, query, chunk, score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, add, out, held = asked.value, _added(k), [], 0
        for batch in batches:
            for ids, (config, length, chunk, term, tf) in zip(batch.column("chunk_idx").to_pylist(), _rows(batch), strict=True):
                chunk_idx, c = np.frombuffer(ids, np.int64), config[chunk]
                part = idf[c, term] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length[chunk] / mean[c]))
                by = np.argsort(c * n_terms + term, kind="stable")
                cuts = np.searchsorted((c * n_terms + term)[by], np.arange(n_configs * n_terms + 1))
                row, part = chunk[by], part[by]
                for at in range(n_configs):
                    begun, n = int(np.searchsorted(config, at)), int((config == at).sum())
                    for q, terms_of in enumerate(own.terms):
                        spans = [(cuts[at * n_terms + t], cuts[at * n_terms + t + 1]) for t in terms_of]
                        spans = sorted(((a, b) for a, b in spans if b > a), key=lambda s: s[1] - s[0])
                        if spans:
                            place, scores = add([row[a:b] - begun for a, b in spans], [part[a:b] for a, b in spans], n, None)
                            out.append((np.full(len(place), at), np.full(len(place), q), chunk_idx[begun + place], scores))
                            held += len(place)
                if held > GATHERED:
                    out = [kept(*map(np.concatenate, zip(*out, strict=True)))]
                    held = 0
        if out:
            config, query, chunk_idx, score = kept(*map(np.concatenate, zip(*out, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(config, pa.int32()), pa.array(query, pa.int32()), pa.array(chunk_idx), pa.array(score)], names=["config", "query", "chunk_idx", "score"])

    found = rows.mapInArrow(run, "config int, query int, chunk_idx long, score double")
    window = Window.partitionBy("config", "query").orderBy(F.desc("score"), "chunk_idx")
    best = found.withColumn("rank", F.row_number().over(window).cast("long")).filter(F.col("rank") <= k)
    names = rows.sparkSession.createDataFrame(list(enumerate(asked.value.ids)), f"query int, query_id {dict(queries.dtypes)['query_id']}")
    return best.join(F.broadcast(names), "query").select("config", "query_id", "chunk_idx", "score", "rank")
