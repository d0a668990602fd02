"""Near duplicates by SimHash fingerprints, searched with pivot distance tables.

The Hamming distances of each fingerprint to many reference fingerprints (pivots) are worked
out once and stay with it. By the triangle inequality two fingerprints within RADIUS differ by
RADIUS at most in every one of these distances, so a pair is discarded by its largest
difference; what is left is verified bit by bit.

Distances to far pivots can't say which fingerprints to bring together in the first place: two
fingerprints at random are within RADIUS of each other in one coordinate with probability 0.57, and a
lossless grid of cells of RADIUS + 1 in k coordinates would leave 0.73**k of all pairs and write each
fingerprint 2.6**k times. So pairs are met by distances inside parts of the word: cut
into m parts, two fingerprints with at most four differing bits agree on m - 4 parts or more
(distance zero), so each pair meets under one of the choices of m - 4 parts. m grows with the
number of fingerprints, so that a key is met by few of them by chance at every size. Keys with
many fingerprints are split into blocks, and pairs of blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import connected_components, joined, stage

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
BLOCK_ROWS = 512
#: Pivots; eight distances make a number of 64 bits.
PIVOTS = 16
#: Parts at least, and fingerprints that may meet under one key by chance.
LEAST_PARTS, BY_CHANCE = 6, 4
_PAIRS_AT_ONCE = 1 << 20


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the splitmix64 sequence from 1 on, the same in every run."""
    out, mask = [], (1 << 64) - 1
    for n in range(1, count + 1):
        z = n * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        out.append(z ^ z >> 31)
    return np.array(out, dtype=np.uint64)


def parts(count: int) -> list[tuple[int, int]]:
    """First bit and width of so many parts of a fingerprint, as equal as can be."""
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def parts_for(number: int) -> int:
    """How many parts to cut so that at most about BY_CHANCE of number fingerprints share a key by chance."""
    count = LEAST_PARTS
    while number > BY_CHANCE << sum(sorted(w for _, w in parts(count))[: count - RADIUS]):
        count += 1
    return count


def with_distances(fingerprints: DataFrame) -> DataFrame:
    """fingerprints (fp) with far0, far1: the distances to the pivots, eight bits each."""

    def packed(refs: np.ndarray):
        bits = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * k) for k, r in enumerate(refs.view(np.int64).tolist())]
        return reduce(lambda x, y: x.bitwiseOR(y), bits)

    return fingerprints.withColumn("far0", packed(pivots()[:8])).withColumn("far1", packed(pivots()[8:]))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text; zero without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; splits at \x20\x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - [len(p) + 1 for p in parts])[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):  # 64 bytes for each hash, for a slice at a time
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _verified(left: np.ndarray, right: np.ndarray, d_left: np.ndarray, d_right: np.ndarray) -> np.ndarray:
    """Which of the pairs (left[k], right[k]) are within RADIUS; d_*: rows of pivot distances."""
    alive = np.arange(len(left))
    for p in range(d_left.shape[1]):
        if not len(alive):
            break
        gap = d_left[alive, p].astype(np.int8) - d_right[alive, p].astype(np.int8)
        alive = alive[np.abs(gap) <= RADIUS]
    return alive[np.bitwise_count(left[alive] ^ right[alive]) <= RADIUS]


def _members(one: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and rows of pivot distances of one list."""
    fp, *far = (one.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "far0", "far1"))
    return fp.view(np.uint64), np.stack(far, axis=1).view(np.uint8).reshape(len(fp), PIVOTS)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b): lists of fingerprints with their distances; b is null where the pairs inside a are meant.

    Gives enough verified links to join what is connected: in a list or pair of lists, each
    fingerprint that has links gets those to the first ones found, by union-find.
    """
    for batch in batches:
        src, dst = [], []
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        wide: list[tuple[np.ndarray, np.ndarray, int | None]] = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            x, far = _members(a.values)
            if b.is_valid:
                y, others = _members(b.values)
                wide.append((np.concatenate([x, y]), np.concatenate([far, others]), len(x)))
            elif len(x) > 32:
                wide.append((x, far, None))
            else:
                by_size.setdefault(len(x), []).append((x, far))
        for n, lists in by_size.items():
            i, j = np.triu_indices(n, 1)
            step = max(1, _PAIRS_AT_ONCE // max(1, len(i)))
            for k in range(0, len(lists), step):
                rows, far = (np.stack(z) for z in zip(*lists[k : k + step], strict=True))
                left, right = rows[:, i].ravel(), rows[:, j].ravel()
                hit = _verified(left, right, far[:, i].reshape(-1, PIVOTS), far[:, j].reshape(-1, PIVOTS))
                src.append(left[hit])
                dst.append(right[hit])
        for every, far, cut in wide:
            a, b = _star(every, far, cut)
            src.append(a)
            dst.append(b)
        if src:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(src).view(np.int64)), pa.array(np.concatenate(dst).view(np.int64))], names=["src", "dst"]
            )


def _star(every: np.ndarray, far: np.ndarray, cut: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is connected within every, or between its first cut rows and the rest: a spanning forest."""
    parent = np.arange(len(every))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    ends = []
    for k in range(len(every) if cut is None else cut):
        others = np.arange(k + 1 if cut is None else cut, len(every))
        hit = others[_verified(np.broadcast_to(every[k], len(others)), every[others], np.broadcast_to(far[k], (len(others), PIVOTS)), far[others])]
        for m in hit.tolist():
            a, b = root(k), root(m)
            if a != b:
                parent[max(a, b)] = min(a, b)
                ends.append((k, m))
    pairs = np.array(ends, dtype=np.int64).reshape(-1, 2)
    return every[pairs[:, 0]], every[pairs[:, 1]]


def candidate_lists(fingerprints: DataFrame, count: int = LEAST_PARTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) lists of (fp, far0, far1) to compare, for distinct fingerprints; b is null for pairs inside a.

    Every pair within RADIUS is in at least one of them. No list is longer than a small
    multiple of block_rows, however many fingerprints share a key.
    """
    cuts = parts(count)
    part = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in cuts]

    def key(chosen: tuple[int, ...]):
        return reduce(lambda k, p: F.shiftleft(k, cuts[p][1]).bitwiseOR(part[p]), chosen[1:], part[chosen[0]])

    keys = F.array(*[F.struct(F.lit(t).alias("t"), key(c).alias("key")) for t, c in enumerate(combinations(range(count), count - RADIUS))])
    keyed = fingerprints.select("fp", "far0", "far1", F.inline(keys))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block_rows)
    member = F.struct("fp", "far0", "far1")
    lists = (
        keyed.join(sizes, ["t", "key"])
        .select("t", "key", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).alias("block"), member.alias("m"))
        .groupBy("t", "key", "blocks", "block")
        .agg(F.collect_list("m").alias("ms"))
    )
    lists = stage(lists, "lists")
    inside = lists.filter(F.size("ms") > 1).select(F.col("ms").alias("a"), F.lit(None).cast(lists.schema["ms"].dataType).alias("b"))
    wide = lists.filter("blocks > 1")
    other = wide.select("t", "key", F.col("block").alias("other"), F.col("ms").alias("b"))
    across = wide.join(other, ["t", "key"]).filter("block < other").select(F.col("ms").alias("a"), "b")
    return inside.union(across)


def simhash_groups(documents: DataFrame) -> DataFrame:
    """doc_id, fp (signed), component_id of every row of documents (doc_id, text).

    component_id is the smallest doc_id reachable by links of at most RADIUS differing bits.
    Null, empty and blank texts have fingerprint zero and link like any other; a null doc_id
    keeps its row but never names a component unless no other id is there. Repeated rows stay
    repeated, other columns are ignored, an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stage(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    distinct = stage(with_distances(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))), "distinct")
    links = candidate_lists(distinct.select("fp", "far0", "far1"), parts_for(distinct.count())).mapInArrow(_linked, "src long, dst long").distinct()
    roots = connected_components(links)
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    linked = stage(linked, "linked")
    least = stage(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "least")
    named = stage(joined(linked, least, ["root"], "members").select("fp", "n", "component_id"), "named")
    return joined(prints, named, ["fp"]).select("doc_id", "fp", "component_id")
