"""Token counts by a tokenizer compiled to finite-state transducers.

The tokenizer (byte-pair merges with word ends) becomes a deterministic transducer that reads
the bytes of a word and writes no tokens: each transition carries the number by which the count
of emitted tokens changes. A state keeps what later bytes can still change: for each recent
position from which some token of the vocabulary may go on, the last token there and the count
relative to now. States and transitions are made when first needed and kept.

Texts up to the size of a chunk are counted where they are read. Longer ones are cut into chunks of
a fixed size, at any character. A chunk maps the state before it to the state after it and to a
count. The state at a chunk's edge is the field (what stands between white space) that is still open there: white space resets the
tokenizer, so whatever the state before a chunk, only its first field depends on it, and the map
is kept as that field, the count of the closed ones and the open one. Normalisation may join characters
over an edge and special strings may lie across one, so states are open fields and not byte states. Maps compose
associatively; the chunks of a text are composed in a tree, BRANCH of them in a task at each
level, so that no task has all of them. A field as long as several chunks is open text in all of these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import stage

CHUNK_CHARS = 1 << 16
#: Maps that are composed in one row at each level of the tree.
BRANCH = 32
_ROWS = 256
#: What a worker keeps: fields, states and pairs of tokens. Beyond it starts anew.
_FIELDS, _STATES, _PAIRS = 1 << 17, 1 << 17, 1 << 16
_POINTS = ".,;:!?*$%&#|"
#: White space as the tokenizer's patterns take it.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Transducer:
    """Deterministic transducer of one word: bytes in, change of the token count out."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.symbols, self.end = byte_symbols(), end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {p: n for n, p in enumerate(pairs)}
        self.vocab = vocab
        #: what each token may be read from: its text without the mark of a word's end
        self.inner = {t for t in vocab if not t.endswith(end)}
        self.last = {t[: -len(end)] for t in vocab if t.endswith(end)}
        self.longest = max(map(len, self.inner | self.last))
        self.open = {t[:k] for t in self.inner | self.last for k in range(1, len(t) + 1)}
        #: state: (recent text, last tokens at its positions, counts there relative to now)
        self.states: dict[tuple, int] = {}
        self.of: list[tuple] = []
        #: transitions by state << 8 | byte, each the next state << 8 | change of the count + 128; and
        #: the changes at the end of a word
        self.next: dict[int, int] = {}
        self.final: dict[int, int] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.start = self._state(("", ("",), (0,)))

    def _state(self, what: tuple) -> int:
        if what not in self.states:
            self.states[what] = len(self.of)
            self.of.append(what)
        return self.states[what]

    def _merged(self, parts: list[str]) -> list[str]:
        """parts after all merges, least rank first, leftmost among equals."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.ranks.get((parts[k], parts[k + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.ranks:
                break
            parts[best : best + 2] = ["".join(pair)]
        return parts

    def _split(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            text = token[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(token)

    def _fit(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when their bytes are tokenized together."""
        if (key := (left, right)) not in self.fits:
            if len(self.fits) > _PAIRS:
                self.fits.clear()
            self.fits[key] = not left or self._merged(self._split(left) + self._split(right)) == [left, right]
        return self.fits[key]

    def _step(self, state: int, byte: int) -> int:
        text, tokens, counts = self.of[state]
        text += self.symbols[byte]
        for k in range(len(text)):  # the longest last token first; position k is before text[k]
            if (piece := text[k:]) in self.inner and tokens[k] is not None and self._fit(tokens[k], piece):
                if self._whole(piece):
                    delta = counts[k] + 1
                    break
        else:
            raise ValueError(f"no token for byte {byte}")
        tokens, counts = (*tokens, piece), (*(c - delta for c in counts), 0)
        keep = next((k for k in range(len(text)) if text[k:] in self.open), len(text))
        return self._state((text[keep:], tokens[keep:], counts[keep:])) << 8 | delta + 128

    @lru_cache(maxsize=_PAIRS)  # noqa: B019  one transducer for each process
    def _whole(self, token: str) -> bool:
        """Whether the merges make token out of its own bytes."""
        return self._merged(self._split(token)) == [token]

    def _finish(self, state: int, byte: int) -> int:
        text, tokens, counts = self.of[state]
        text += self.symbols[byte]
        for k in range(len(text)):
            if (piece := text[k:]) in self.last and self._fit(tokens[k], piece + self.end) and self._whole(piece + self.end):
                return counts[k] + 1
        raise ValueError(f"no token ends a word with byte {byte}")

    def count(self, word: bytes) -> int:
        """The number of tokens of one word."""
        if len(self.of) > _STATES:
            self.__dict__.update(states={}, of=[], next={}, final={})
            self.start = self._state(("", ("",), (0,)))
        total, at, known = 0, self.start, self.next
        for byte in word[:-1]:
            key = at << 8 | byte
            if key not in known:
                known[key] = self._step(at, byte)
            at, change = known[key] >> 8, (known[key] & 255) - 128
            total += change
        key = at << 8 | word[-1]
        if key not in self.final:
            self.final[key] = self._finish(at, word[-1])
        return total + self.final[key]


class ChunkMap(NamedTuple):
    """What a chunk does to a count: the words at its edges wait for their neighbours.

    Without white space inside (broken is false) the whole chunk is in head.
    """

    head: str
    count: int
    tail: str
    broken: bool


class Counter:
    """Counts of whole texts and maps of chunks for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError("a BPE tokenizer with word ends is asked for")
        self.word = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.marks = [t["content"] for t in spec["added_tokens"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.space = regex.compile(SPACE + "+")
        # the library's own normaliser and word splitter: Unicode tables differ between versions
        whole = Tokenizer.from_str(json.dumps(spec))
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.fields: dict[str, int] = {}

    def _plain(self, text: str) -> int:
        if text.isascii():
            return sum(self.word.count(w.encode()) for w in self.words.findall(text.lower()))
        said = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return sum(self.word.count(bytes(map(self.byte_of.__getitem__, w))) for w, _ in said)

    def field(self, text: str) -> int:
        """Tokens of a text without white space; kept for the next time."""
        if (n := self.fields.get(text)) is None:
            if len(self.fields) > _FIELDS:
                self.fields.clear()
            word = text.rstrip(_POINTS)
            if word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):
                # Latin letters, composed already, each with one small letter; then points: two words at most
                n = self.word.count(word.lower().encode()) if len(word) == len(text) else self.field(word) + self.field(text[len(word) :])
            else:
                n = len(self.special.findall(text)) if any(m in text for m in self.marks) else 0
                n += sum(map(self._plain, self.special.split(text))) if n else self._plain(text)
            if len(text) <= 64:
                self.fields[text] = n
        return n

    def chunk(self, text: str) -> ChunkMap:
        parts = self.space.split(text) if not text.isascii() else _ascii_fields(text, self.space)
        if len(parts) == 1:
            return ChunkMap(text, 0, "", False)
        known = self.fields
        total = 0
        for part in parts[1:-1]:
            n = known.get(part)
            total += self.field(part) if n is None else n
        return ChunkMap(parts[0], total, parts[-1], True)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's text followed by b's; associative."""
        if not b.broken:
            return ChunkMap(a.head, a.count, a.tail + b.head, True) if a.broken else ChunkMap(a.head + b.head, 0, "", False)
        if not a.broken:
            return ChunkMap(a.head + b.head, b.count, b.tail, True)
        return ChunkMap(a.head, a.count + self.field(a.tail + b.head) + b.count, b.tail, True)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Maps of all prefixes, by doubling: a step composes maps of twice as many chunks."""
        out, gap = list(maps), 1
        while gap < len(out):
            out = out[:gap] + [self.compose(out[k - gap], out[k]) for k in range(gap, len(out))]
            gap *= 2
        return out

    def whole(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of all chunks together: neighbours in pairs, then pairs of pairs."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def total(self, whole: ChunkMap) -> int:
        return (self.field(whole.head) if whole.head else 0) + whole.count + (self.field(whole.tail) if whole.tail else 0)


def _ascii_fields(text: str, space) -> list[str]:
    """Fields of an ASCII text; the ends are empty where it starts or ends with white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes them for white space, the tokenizer doesn't
        return space.split(text)
    parts = text.split()
    if not parts:
        return ["", ""] if text else [""]
    return [""] * text[0].isspace() + parts + [""] * text[-1].isspace()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


_MAP = "row long, pos long, head string, count long, tail string, broken boolean"


def _as_batch(rows: list[int], places: list[int], maps: list[ChunkMap]) -> pa.RecordBatch:
    columns = [rows, places, *(zip(*maps, strict=True) if maps else ([], [], [], []))]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "pos", "head", "count", "tail", "broken"])


def _counted(path: str):
    """Rows (doc_id, n_bytes, text) to their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column("text")
            counts = [c.total(c.chunk(t)) for k in range(0, len(texts), _ROWS) for t in texts.slice(k, _ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk_chars: int):
    """Rows (row, text) to (row, pos, chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row"), batch.column("text"), strict=True):
                text, row = text.as_py(), row.as_py()
                for first in range(0, len(text), chunk_chars * _ROWS):  # so many chunks at a time
                    cuts = range(first, min(len(text), first + chunk_chars * _ROWS), chunk_chars)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(cuts), pa.int64()), pa.array([k // chunk_chars for k in cuts], pa.int64()), pa.array([text[k : k + chunk_chars] for k in cuts], pa.string())],
                        names=["row", "pos", "chunk"],
                    )

    return run


def _mapped(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            maps = [c.chunk(t) for t in batch.column("chunk").to_pylist()]
            yield _as_batch(batch.column("row").to_pylist(), batch.column("pos").to_pylist(), maps)

    return run


def _composed(path: str):
    """Rows (row, pos, maps): up to BRANCH neighbours become one map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            ordered = [sorted(maps, key=lambda m: m["pos"]) for maps in batch.column("maps").to_pylist()]
            whole = [c.whole([ChunkMap(m["head"], m["count"], m["tail"], m["broken"]) for m in maps]) for maps in ordered]
            yield _as_batch(batch.column("row").to_pylist(), batch.column("pos").to_pylist(), whole)

    return run


def _closed(path: str):
    """Rows of whole texts' maps to (row, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("head", "count", "tail", "broken"))
            totals = [c.total(ChunkMap(*m)) for m in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(totals, pa.int64())], names=["row", "n_tokens"])

    return run


def _long_counts(texts: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of texts longer than a chunk."""
    # numbered in a written table: a task that runs again finds the same numbers
    rows = stage(texts.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    last = rows.agg(F.max(F.floor((F.char_length("text") - 1) / chunk_chars))).first()[0]
    if last is None:
        return rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    chunks = rows.select("row", "text").mapInArrow(_cut(chunk_chars), "row long, pos long, chunk string")
    maps = chunks.repartition("row", "pos").mapInArrow(_mapped(path), _MAP)
    while last > 0:
        met = maps.groupBy("row", F.floor(F.col("pos") / BRANCH).alias("pos")).agg(F.collect_list(F.struct("pos", "head", "count", "tail", "broken")).alias("maps"))
        maps, last = stage(met.mapInArrow(_composed(path), _MAP), "chunk-maps"), last // BRANCH
    counts = maps.mapInArrow(_closed(path), "row long, n_tokens long")
    return rows.select("row", "doc_id", "n_bytes").join(counts, "row").select("doc_id", "n_bytes", "n_tokens")


def token_counts(documents: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of documents (doc_id, text).

    path names a tokenizer file of the tokenizers library (BPE with word ends), present on every
    machine. Special strings inside a text are one token each, none is added. Null and empty
    texts have no tokens; a null doc_id and repeated rows keep their rows; other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    # bytes first: they are known without reading the text
    long = (F.col("n_bytes") > chunk_chars) & (F.char_length("text") > chunk_chars)
    short = rows.filter(~long).mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")
    return short.union(_long_counts(rows.filter(long), path, chunk_chars))
