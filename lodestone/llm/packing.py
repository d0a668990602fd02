"""Packing of tokenized documents into sequences by minimum bin slack.

A bin is opened for the longest piece left; subset-sum over the lengths that are left, as one
integer whose bits are the reachable sums, finds the combination that fills it best, and the
combination is removed. Only lengths matter for that, so the plan is made from the number of
pieces of each length: a table with one row for each length up to the capacity, whatever the
number of documents. A combination found once is used for as many bins as its lengths allow,
since it stays the fullest until one of them runs out.

The pieces then take their places by themselves: the n-th piece of a length goes to the n-th
place planned for that length. n comes from the numbers of pieces that each task has seen, so no
task and no group ever holds all pieces of one length.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.llm.token_counts import byte_symbols

CAPACITY = 2048
END_ID = 0
_ROWS = 256
#: Fixed value: how byte-level tokenizers cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: tiktoken runs out of stack on a run of about a million white space characters before other text.
LONGEST_RUN = 100_000
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{LONGEST_RUN}}}")


class Encoder:
    """Ids of whole texts by a byte-level tokenizers file, as little-endian unsigned 32-bit numbers.

    Texts with special strings or very long runs of white space go to the tokenizers library. For all others its ids are those of
    the same vocabulary read as ranks, which tiktoken works out in a third of the time and
    without keeping words; the tests compare the two on whole tables.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level tokenizer without normalisation is asked for")
        self.marks = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: n for n, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in self.marks}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(m in text for m in self.marks) or len(text) >= LONGEST_RUN and _LONG_RUN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        enc, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = enc.encode(text or "") + end
                total = len(raw) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    ids = raw[4 * a : 4 * b]
                    row = (doc_id, n, a, b - a, zlib.crc32(ids), seen[b - a], np.frombuffer(ids, "<u4") if with_ids else None)
                    seen[b - a] += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(np.full(len(out[0]), part, np.int32))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "n", "ids", "part"],
            )

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to room as can be."""
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if 0 < n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= sums << length * take & mask
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths in each of them), in the order in which the bins are filled."""
    left, bins = {n: c for n, c in counts.items() if c > 0}, []
    while left:
        longest = max(left)
        others = {**left, longest: left[longest] - 1}
        chosen = fullest(others, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        bins.append((times, chosen))
        for n, k in chosen.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset of the first copy), sorted."""
    used, first_bin, rows = Counter(), 0, []
    for times, chosen in bins:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append((length, used[length], chosen[length], first_bin, offset))
            used[length] += times * chosen[length]
            offset += length * chosen[length]
        first_bin += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(places: np.ndarray):
    key = places[:, 0].astype(np.uint64) << np.uint64(48) | places[:, 1].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = places[np.searchsorted(key, length.astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64), side="right") - 1]
            bin_, copy = np.divmod(rank - row[:, 1], row[:, 2])
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(row[:, 3] + bin_), pa.array(row[:, 4] + copy * length)],
                names=[*keep, "sequence_id", "offset"],
            )

    return run


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    documents: doc_id, text; path: a file of the tokenizers library, present on every machine.
    Each document's ids are followed by id 0; only documents over capacity are cut. Null and
    empty texts are that one id. A null doc_id and repeated rows are packed like any other row;
    other columns are ignored; an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, n long, ids array<int>, part int"
    pieces = stage(rows.mapInArrow(_pieces(path, capacity, with_ids), schema), "pieces")
    seen = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("count")), "seen")
    # at most one row for each length up to the capacity
    counts = {r["length"]: r["count"] for r in seen.groupBy("length").agg(F.sum("count").alias("count")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    ranked = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("skip") + F.col("n")).alias("rank")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(_placed(_places(plan(counts, capacity))), out)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids of every sequence of pack(..., with_ids=True); capacity bounds each row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
