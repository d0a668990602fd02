"""Language identification with string kernels.

A text is the set of its character n-grams of one to three characters (blended spectrum,
presence only). The kernel of two texts is the number of n-grams that both have over the
geometric mean of their numbers. Nyström landmarks, some training texts of each language, turn
the kernel into one column for each landmark; kernel ridge regression on them, one language
against the rest, gives the scores. Scoring is two matrix products for a batch of texts:
n-grams by landmarks, then landmarks by languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.common import looked_up, stage

#: Characters are folded to so many classes: 0 for all but letters, 1 to 26 for a to z, and the
#: rest of the letters dealt over what is left.
CLASSES = 128
SPECTRUM = 3
#: Training rows of each language (expected number, picked by a hash of doc_id) and of all languages
#: together, where each has LEAST_ROWS at least: these bound what the driver gathers.
ROWS_PER_LANGUAGE, ROWS, LEAST_ROWS = 400, 20_000, 8
#: Landmarks over all languages, one of each at least.
LANDMARKS = 240
RIDGE = 1e-3
UNDETERMINED = "und"
_SLICE = 1 << 20
_CELLS = 1 << 22
_FIRST = [0, CLASSES, CLASSES + CLASSES**2]
CODES = CLASSES + CLASSES**2 + CLASSES**3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (CLASSES - 27)
    return out


def ngrams(text: str | None) -> np.ndarray:
    """The distinct n-grams of the whole text, as sorted codes; empty if it has no letter."""
    table = _classes()
    seen: np.ndarray | None = None
    text = text or ""
    found = []
    for k in range(0, max(1, len(text)), _SLICE):
        part = text[max(0, k - SPECTRUM + 1) : k + _SLICE]
        cls = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int32)
        cls = np.concatenate([[0], cls, [0]]).astype(np.int32)
        cls = cls[np.append(True, (cls[1:] != 0) | (cls[:-1] != 0))]  # one gap between words
        if not cls.any():
            continue
        two = cls[:-1] * CLASSES + cls[1:]
        codes = np.concatenate([cls, _FIRST[1] + two, _FIRST[2] + two[:-1] * CLASSES + cls[2:]])
        if len(text) <= _SLICE:
            found.append(_distinct(codes))
        else:
            seen = np.zeros(CODES, dtype=bool) if seen is None else seen
            seen[codes] = True
    if seen is not None:
        return np.flatnonzero(seen).astype(np.int32)
    return found[0] if found else np.zeros(0, dtype=np.int32)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return np.zeros(CODES, dtype=np.int32)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Distinct codes: each code's last position is written to its place and read again."""
    place, at = _places(), np.arange(len(codes), dtype=np.int32)
    place[codes] = at
    return np.sort(codes[place[codes] == at])


@dataclass(frozen=True)
class Model:
    """vocabulary: n-grams of the landmarks; landmarks: one column each; weights: by landmark and language."""

    languages: tuple[str, ...]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given as n-gram sets, with all landmarks."""
        columns = np.full(CODES, -1, dtype=np.int32)
        columns[self.vocabulary] = np.arange(len(self.vocabulary))
        landmarks, out = self.landmarks.astype(np.float32), []
        step = max(1, _CELLS // max(1, len(self.vocabulary)))
        for k in range(0, len(sets), step):
            some = sets[k : k + step]
            present = np.zeros((len(some), len(self.vocabulary)), dtype=np.float32)
            for row, codes in zip(present, some, strict=True):
                at = columns[codes]
                row[at[at >= 0]] = 1
            size = np.array([max(1, len(s)) for s in some], dtype=np.float64)
            out.append((present @ landmarks).astype(np.float64) / np.sqrt(size[:, None] * self.sizes[None, :]))
        return np.concatenate(out) if out else np.zeros((0, len(self.sizes)))

    def predict(self, sets: list[np.ndarray]) -> tuple[list[str], list[float]]:
        """Language and score of texts, given as n-gram sets. Ties go to the first language by name."""
        if not self.languages:
            return [UNDETERMINED] * len(sets), [0.0] * len(sets)
        share = np.clip((self.kernel(sets) @ self.weights + 1) / 2, 1e-9, 1)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        some = [len(s) > 0 for s in sets]
        return (
            [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), some, strict=True)],
            [s if ok else 0.0 for s, ok in zip(share.max(axis=1).tolist(), some, strict=True)],
        )


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression on Nyström landmarks, the first texts of each language."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros(0, np.int32), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0)))
    each, taken, chosen = max(1, landmarks // len(languages)), dict.fromkeys(languages, 0), []
    for k, label in enumerate(labels):
        if taken[label] < each:
            taken[label] += 1
            chosen.append(k)
    vocabulary = np.unique(np.concatenate([sets[k] for k in chosen]))
    columns = np.zeros((len(vocabulary), len(chosen)), dtype=np.uint8)
    for n, k in enumerate(chosen):
        columns[np.searchsorted(vocabulary, sets[k]), n] = 1
    sizes = np.array([len(sets[k]) for k in chosen], dtype=np.float64)
    model = Model(languages, vocabulary, columns, sizes, np.zeros((len(chosen), len(languages))))
    every = model.kernel(sets)
    among = every[chosen]
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    left = every.T @ every + ridge * len(sets) * (among + among.T) / 2 + 1e-8 * len(sets) * np.eye(len(chosen))
    return Model(languages, vocabulary, columns, sizes, np.linalg.solve(left, every.T @ targets))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [ngrams(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("order"), pa.array(sets, pa.list_(pa.int32()))], names=["lang", "order", "codes"]
        )


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS) -> Model:
    """A model of all languages in labelled rows (doc_id, text, lang); rows without a language or text are left out.

    About rows_per_language rows of each language are used, fewer where there are so many
    languages that they would be more than rows together; those whose doc_id has the least
    hashes. The n-gram sets of that many rows come to the driver, as one array.
    """
    told = labelled.filter("lang is not null and text is not null")
    counts = stage(told.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    number = counts.count()
    if not number:
        return fit([], [])
    each = max(LEAST_ROWS, min(rows_per_language, rows // number))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    picked = looked_up(told.select("doc_id", "text", "lang", order.alias("order")), counts, "lang", "doc_id").filter(F.col("order") < F.lit(float(each << 40)) / F.col("n"))
    sample = picked.select("lang", "order", "text").mapInArrow(_sampled, "lang string, order long, codes array<int>").toArrow().combine_chunks()
    langs, at = sample.column("lang").to_pylist(), sample.column("order").to_pylist()
    batch = sample.to_batches()[0].column("codes") if sample.num_rows else pa.array([], pa.list_(pa.int32()))
    ends, codes = batch.offsets.to_numpy(), batch.values.to_numpy()
    sets = [codes[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    chosen = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: (at[k], langs[k], len(sets[k]), sets[k].tobytes()))
    return fit([sets[k] for k in chosen], [langs[k] for k in chosen])


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, texts = [], [], batch.column("text")
            for k in range(0, len(texts), 256):
                found = model.value.predict([ngrams(t) for t in texts.slice(k, 256).to_pylist()])
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"]
            )

    return run


def predict_language(documents: DataFrame, model: Model) -> DataFrame:
    """documents (text and any other columns) with lang_pred and score; columns of these names there are replaced.

    Whole texts are read. A text that is null or has no letter is und, with score 0; the score
    is the share of the best language and lies between 0 and 1. Repeated rows stay repeated, an
    empty table gives an empty result; without a trained language all rows are und.
    """
    documents = documents.drop("lang_pred", "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*documents.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return documents.mapInArrow(_predicted(shared), schema)


def language_of(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents (doc_id, text, lang).

    Rows that are not held out and have a language train the model.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(rows.filter(~held_out(F.col("doc_id"))))
    return predict_language(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
