"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. Equal blocks get one integer name,
found by sorting the distinct blocks; then adjacent pairs of names are named in the same way,
round by round, until one name is left for each document. A name stands for one content and
never for two, so two documents have the same identity exactly if their texts are equal.

Only documents all of whose blocks occur again can have an equal one, so only these are named.
Which blocks occur again is looked up by digest in a bitmap of a fixed size: it may say yes too
often, which costs work, and never no for a block that does. Where so many blocks occur again
that the bitmap would say little, documents with a block that occurs once go by an anti-join.
Digests rule documents out; they never make two of them equal.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import joined, stage

BLOCK_BYTES = 4096
BITMAP_BITS = 1 << 26
#: With more repeated blocks than this, an eighth of the bits would be set: then an anti-join rules out.
MOST_REPEATED = BITMAP_BITS // 8


def _normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def _digests(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import xxhash

        for batch in batches:
            sha, blocks = [], []
            for text in batch.column("text").to_pylist():
                raw = _normalised(text)
                sha.append(hashlib.sha256(raw).hexdigest())
                blocks.append([xxhash.xxh3_128_digest(raw[k : k + block_bytes]) for k in range(0, max(1, len(raw)), block_bytes)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sha, pa.string()), pa.array(blocks, pa.list_(pa.binary()))],
                names=["doc_id", "text_sha256", "blocks"],
            )

    return run


def _slot(digest: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(digest, 42) & (BITMAP_BITS - 1)  # as xxhash64() gives it


def _contents(block_bytes: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import xxhash

        bits = bitmap and bitmap.value
        for batch in batches:
            doc, sha, pos, block = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = _normalised(text)
                blocks = [raw[k : k + block_bytes] for k in range(0, max(1, len(raw)), block_bytes)]
                slots = (_slot(xxhash.xxh3_128_digest(b)) for b in blocks)
                if bits is None or all(bits[s >> 3] >> (s & 7) & 1 for s in slots):
                    doc += [doc_id] * len(blocks)
                    sha += [hashlib.sha256(raw).hexdigest()] * len(blocks)
                    pos += range(len(blocks))
                    block += blocks
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(sha, pa.string()), pa.array(pos, pa.int64()), pa.array(block, pa.binary())],
                names=["doc_id", "text_sha256", "pos", "block"],
            )

    return run


def _bitmap(digests: DataFrame) -> np.ndarray:
    """The slots of digests as BITMAP_BITS bits, least bit first; gathered as words of 64."""
    slot = F.xxhash64("digest").bitwiseAND(F.lit(BITMAP_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))")
    words = digests.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _named(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """The distinct values of columns with n, how many rows have them, and an integer name: the place in the order of all of them, by a hash and then by value.

    Ranges of the order are sorted in a task each; a value's place is its place there and the
    number of values in the ranges before. So names don't depend on the number of tasks. By their hash
    values make ranges of equal size, and what is sampled for the bounds is short.
    """
    ordered = rows.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("key", F.xxhash64(*columns)).repartitionByRange("key").sortWithinPartitions("key", *columns)
    numbered = stage(ordered.drop("key").withColumn("at", F.monotonically_increasing_id()), label)  # the task's number, then 33 bits
    sizes = {r["part"]: r["n"] for r in numbered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a task
    firsts = rows.sparkSession.createDataFrame(list(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False)), "part long, first long")
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(firsts), "part").select(*columns, "n", (F.col("first") + place).alias("name"))


def _without_single_blocks(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """texts without the rows that have a block which occurs nowhere else."""
    exploded = digests.select("doc_id", "text_sha256", F.explode("blocks").alias("digest"))
    alone = exploded.groupBy("digest").agg(F.first(F.struct("doc_id", "text_sha256")).alias("row"), F.count("*").alias("n")).filter("n = 1")
    out = alone.select("row.*").distinct().alias("o")
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)
    same_row = F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("t.sha") == F.col("o.text_sha256"))
    return texts.withColumn("sha", sha).alias("t").join(out, same_row, "left_anti").select("doc_id", "text")


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, most_repeated: int = MOST_REPEATED) -> tuple[DataFrame, DataFrame]:
    """Two tables: all rows (doc_id, text_sha256), and (doc_id, text_sha256, size, name) of
    documents that may have an equal one.

    size (blocks) and name together identify a text. A row of documents that the second table
    lacks has no equal row. Rows that are repeated as a whole stand there once.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = stage(texts.mapInArrow(_digests(block_bytes), "doc_id long, text_sha256 string, blocks array<binary>"), "digests")
    counts = digests.select(F.explode("blocks").alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    repeated = stage(counts.filter("n > 1").select("digest"), "repeated")
    bitmap = None
    if repeated.count() <= most_repeated:
        bitmap = documents.sparkSession.sparkContext.broadcast(_bitmap(repeated))
    else:
        texts = _without_single_blocks(texts, digests)
    blocks = stage(
        texts.mapInArrow(_contents(block_bytes, bitmap), "doc_id long, text_sha256 string, pos long, block binary"), "blocks"
    )
    level = stage(joined(blocks, _named(blocks, ["block"], "block-names"), ["block"]).select("doc_id", "text_sha256", "pos", "name").distinct(), "level")
    sizes = level.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("size"))
    rounds = 0
    while not level.filter("pos > 0").isEmpty():
        pairs = level.groupBy("doc_id", "text_sha256", F.floor(F.col("pos") / 2).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = stage(pairs, "pairs")
        names = _named(pairs, ["left", "right"], f"pair-names-{rounds}")
        level = stage(joined(pairs, names, ["left", "right"]).select("doc_id", "text_sha256", "pos", "name"), "level")
        rounds += 1
    same_row = [F.col("l.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("l.text_sha256") == F.col("s.text_sha256")]
    named = level.alias("l").join(sizes.alias("s"), same_row).select("l.doc_id", "l.text_sha256", "s.size", "l.name")
    return digests.select("doc_id", "text_sha256"), named


def exact_dedup(documents: DataFrame, block_bytes: int = BLOCK_BYTES, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with
    the largest doc_id of equal texts stays. Other columns are ignored. Rows with a null doc_id
    are dropped in favour of any that has one; if none has, keep_id is null and they stay. A
    doc_id that several rows share is that many rows, which all stay or all go. An empty table
    gives an empty result.
    """
    rows, named = identities(documents, block_bytes, most_repeated)
    key = [F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("r.text_sha256") == F.col("i.text_sha256")]
    found = stage(rows.alias("r").join(named.alias("i"), key, "left").select("r.*", "i.size", "i.name"), "identities")
    groups = stage(
        found.filter("name is not null").groupBy("size", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    alone = found.filter("name is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256"
    )
    shared = joined(found.filter("name is not null"), groups, ["size", "name"], "group_size").select("doc_id", "keep_id", "group_size", "text_sha256")
    return alone.union(shared).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
