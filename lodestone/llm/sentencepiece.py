"""SentencePiece encoding and decoding: Viterbi over a double-array trie of scored pieces.

The file's pieces and scores are used as they are; the segmentation of a text is the one whose
scores have the greatest sum (unigram). Characters that no piece covers become byte pieces. A
space is a marker at the front of a piece, so no piece crosses from a word to the marker of the
next one; words are segmented by themselves and kept.

All new words of a batch walk through the trie and the Viterbi recurrence together, one array
operation for each position inside a word; very long words go through the same recurrence one by
one. The ids of texts are then gathered from the
ids of words, and decoding gathers the bytes of pieces, so neither has a loop over ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
#: What an uncovered character costs below the least score, as the public library has it.
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_ROWS = 256
#: Words that a worker keeps, about; beyond it starts anew.
_KEPT = 1 << 18
#: Longer words are segmented one by one and not kept.
_LONG = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class DoubleArray:
    """A trie of strings in two arrays: the child of s by code c is t = base[s] + c if check[t] is s."""

    def __init__(self, keys: dict[str, int]):
        codes: dict[str, int] = {}
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for c in key:
                node = node.setdefault(codes.setdefault(c, len(codes) + 1), {})
            node[0] = value
        self.codes, self.base, self.check, self.value = codes, [0], [-1], [-1]
        free, queue = 1, [(0, tree)]
        for state, node in queue:
            self.value[state] = node.get(0, -1)
            steps = sorted(c for c in node if c)
            if not steps:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            base = max(0, free - steps[0])
            while any(base + c < len(self.check) and self.check[base + c] >= 0 or base + c == 0 for c in steps):
                base += 1
            grow = base + steps[-1] + 1 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            self.base[state] = base
            for c in steps:
                self.check[base + c] = state
                queue.append((base + c, node[c]))

    def prefixes(self, text: list[int], at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that text, as codes, has from at on, shortest first."""
        state, base, check = 0, self.base, self.check
        for end in range(at, len(text)):
            step = base[state] + text[end]
            if text[end] == 0 or step >= len(check) or check[step] != state:
                return
            state = step
            if self.value[state] >= 0:
                yield end + 1, self.value[state]


class _Walk:
    """The trie and the recurrence over many words at once."""

    def __init__(self, trie: DoubleArray, scores: list[float], worst: float, bytes_: dict[int, int]):
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (trie.base, trie.check, trie.value))
        self.scores = np.array([*scores, worst])  # the last one is that of a character without a piece
        self.bytes = np.array([bytes_[b] for b in range(256)], np.int32)
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in trie.codes]] = list(trie.codes.values())

    def _edges(self, codes: np.ndarray, stop: np.ndarray) -> Iterator[np.ndarray]:
        """(start, size, piece) of all pieces in the words, then of single characters without one."""
        alive, state, depth = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0
        single = np.zeros(len(codes), bool)
        while len(alive):
            code = codes[alive + depth]
            step = self.base[state] + code
            ok = (code > 0) & (step < len(self.check))
            ok[ok] = self.check[step[ok]] == state[ok]
            alive, state, depth = alive[ok], step[ok], depth + 1
            value = self.value[state]
            hit = value >= 0
            yield np.stack([alive[hit], np.full(hit.sum(), depth), value[hit]])
            if depth == 1:
                single[alive[hit]] = True
            more = alive + depth < stop[alive]
            alive, state = alive[more], state[more]
        lone = np.flatnonzero(~single)
        yield np.stack([lone, np.ones(len(lone), np.int64), np.full(len(lone), len(self.scores) - 1)])

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. Ties go as in Pieces.best."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(words)), sizes)
        start, size, piece = np.concatenate(list(self._edges(self.codes[points], first[1:][word])), axis=1)
        # places between characters: one more for each word than it has characters
        origin = first[:-1] + np.arange(len(words))
        total = np.full(len(points) + len(words), -np.inf)
        total[origin] = 0.0
        back, taken = np.zeros(len(total), np.int64), np.zeros(len(total), np.int32)
        inside = start - first[word[start]]
        order = np.argsort(inside.astype(np.uint16), kind="stable")
        begin, size, piece = (start + word[start])[order], size[order], piece[order]
        worth = self.scores[piece]
        cuts = np.searchsorted(inside[order], np.arange(int(sizes.max()) + 1)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):  # from the same start, edges end at different places
            score = total[begin[a:b]] + worth[a:b]
            end = begin[a:b] + size[a:b]
            better = score > total[end]
            end = end[better]
            total[end], back[end], taken[end] = score[better], begin[a:b][better], piece[a:b][better]
        at, who, found, steps = origin + sizes, np.arange(len(words)), [], 0
        while len(at):
            before = back[at]
            found.append(np.stack([who, np.full(len(at), steps), taken[at], before - who]))
            more = before > origin[who]
            at, who, steps = before[more], who[more], steps + 1
        rows, step, ids, chars = np.concatenate(found, axis=1)
        # a word's last piece was found first
        number = np.bincount(rows, minlength=len(words))
        to = np.cumsum(number)[rows] - 1 - step
        ids[to], chars[to], rows[to] = ids.copy(), chars.copy(), rows.copy()
        return self._bytes(points, rows, ids.astype(np.int32), chars, number)

    def _bytes(self, points: np.ndarray, rows: np.ndarray, ids: np.ndarray, chars: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the characters that have no piece as bytes."""
        lone = np.flatnonzero(ids == len(self.scores) - 1)
        if not len(lone):
            return ids, number
        kinds, which = np.unique(points[chars[lone]], return_inverse=True)
        coded = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in kinds.tolist()]
        more = np.array([len(c) for c in coded])[which]
        times = np.ones(len(ids), np.int64)
        times[lone] = more
        out = np.repeat(ids, times)
        out[np.repeat(ids == len(self.scores) - 1, times)] = self.bytes[np.concatenate([coded[k] for k in which.tolist()])]
        return out, number + np.bincount(rows[lone], weights=more - 1, minlength=len(number)).astype(np.int64)


class _Store:
    """Words with their ids, one after the other in an array that grows."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.used = self.words = 0

    @staticmethod
    def _room(array: np.ndarray, needed: int) -> np.ndarray:
        return array if needed <= len(array) else np.concatenate([array, np.zeros(max(needed, 2 * len(array)) - len(array), array.dtype)])

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        used, n = self.used + len(ids), self.words + len(words)
        self.ids = self._room(self.ids, used)
        self.first, self.size = self._room(self.first, n), self._room(self.size, n)
        self.ids[self.used : used] = ids
        self.first[self.words : n], self.size[self.words : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.at.update(zip(words, range(self.words, n), strict=True))
        self.used, self.words = used, n

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and how many each has."""
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.first[at] - ends + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


class Pieces:
    """The pieces of a model file, to encode and decode with."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix, self.squeeze, self.escape = True, True, True
        with open(path, "rb") as file:
            data = file.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("only models with identity normalisation are read")
                self.prefix, self.squeeze, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        found = {p: n for n, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (_NORMAL, _USER)}
        if any(MARK in p.lstrip(MARK) for p in found):
            raise ValueError("a piece has a marker inside")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): n for n, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.byte_of = {n: b for b, n in self.bytes.items()}
        self.worst = min(s for s, k in zip(self.scores, self.kinds, strict=True) if k == _NORMAL) - UNKNOWN_PENALTY
        self.trie = DoubleArray(found)
        self.walk = _Walk(self.trie, self.scores, self.worst, self.bytes) if self.bytes else None
        self.store = _Store()
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        #: what each id is decoded to; the bytes of a character stand side by side
        texts = [p.replace(MARK, " ") if self.escape else p for p in self.pieces]
        said = [
            bytes([self.byte_of[n]]) if n in self.byte_of else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else t.encode()
            for n, (t, k) in enumerate(zip(texts, self.kinds, strict=True))
        ]
        self.said = pa.array(said, pa.large_binary())

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = " " * self.prefix + text
        return text.replace(" ", MARK) if self.escape else text

    def best(self, text: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores; of equals the first found wins,
        which is the one whose last piece is longest."""
        codes = [self.trie.codes.get(c, 0) for c in text]
        size = len(text)
        total: list[float | None] = [0.0] + [None] * size
        back: list[tuple[int, int]] = [(0, 0)] * (size + 1)
        for at in range(size):
            here, single = total[at], False
            for end, piece in self.trie.prefixes(codes, at):
                score = here + self.scores[piece]
                if total[end] is None or score > total[end]:
                    total[end], back[end] = score, (at, piece)
                single |= end == at + 1
            if not single and (total[at + 1] is None or here + self.worst > total[at + 1]):
                total[at + 1], back[at + 1] = here + self.worst, (at, self.unknown)
        out: list[int] = []
        while size:
            at, piece = back[size]
            if piece == self.unknown and self.bytes:
                out += [self.bytes[b] for b in reversed(text[at:size].encode("utf-8", "surrogatepass"))]
            elif not (piece == self.unknown and out and out[-1] == self.unknown):  # a run of unknowns is one
                out.append(piece)
            size = at
        return out[::-1]

    def _learn(self, new: list[str]) -> None:
        """Segment words and keep their ids."""
        short = [w for w in new if len(w) <= _LONG] if self.walk else []
        if short:
            self.store.add(short, *self.walk.best(short))
        for w in new:
            if len(w) > _LONG or not self.walk:
                ids = np.array(self.best(w), np.int32)
                self.store.add([w], ids, np.array([len(ids)]))

    def encode_all(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        if len(self.store.at) > _KEPT:
            self.store = _Store()
        words = [self.words.findall(self.normalised(t or "")) for t in texts]
        at = self.store.at
        if new := [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in at]:
            self._learn(new)
        found = np.fromiter(map(at.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        ids, sizes = self.store.gathered(found)
        for w in new:  # a word this long is met again in few texts
            if len(w) > _LONG:
                del at[w]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """The text of each list of ids: markers become spaces, bytes characters, the added first space goes."""
        ends, flat = ids.offsets.to_numpy(), ids.values
        said = self.said.take(flat.slice(ends[0], ends[-1] - ends[0]))
        places = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1) if len(said) else np.zeros(1, np.int64)
        raw = memoryview(said.buffers()[2] or b"")
        cuts = places[ends - ends[0]].tolist()
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
        if self.prefix:
            texts = [t[1:] if t.startswith(" ") else t for t in texts]
        return texts if not ids.null_count else [t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist(), strict=True)]

    def decode(self, ids: list[int] | None) -> str:
        return self.decode_all(pa.array([ids or []], pa.list_(pa.int32())))[0]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _with(schema: StructType, field: StructField) -> StructType:
    return StructType([*schema.fields, field])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, _ROWS):
            yield whole.slice(k, _ROWS)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """documents (text and any other columns) with ids: array<int>; a column ids there is replaced.

    path names a model file of the sentencepiece library with identity normalisation, present on
    every machine. Null and empty texts have no ids. Whole texts are read; repeated rows stay
    repeated; an empty table gives an empty result.
    """
    documents = documents.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids = pieces(path).encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return documents.mapInArrow(run, _with(documents.schema, StructField("ids", ArrayType(IntegerType()))))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids and any other columns) with decoded: the text of ids; null for null. A column decoded there is replaced."""
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = pieces(path).decode_all(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, _with(encoded.schema, StructField("decoded", StringType())))


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_equal of every row of documents (doc_id, text).

    One pass encodes and decodes. A null text counts as empty; a null doc_id and repeated rows
    keep their rows; other columns are ignored; an empty table gives an empty result.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            model, texts = pieces(path), batch.column("text").to_pylist()
            ids = model.encode_all(texts)
            same = [a == b for a, b in zip(model.decode_all(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(same, pa.bool_())], names=["doc_id", "ids", "same"])

    both = rows.mapInArrow(run, "doc_id long, ids array<int>, same boolean")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.col("same").alias("decoded_equal"),
    )
