"""Uploaded files to text: kind, size, archive guard, tidying, caps."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import decoded, file_kind, replacement_ratio, tidied

# Limits of an upload.
MAX_BYTES, MAX_UNPACKED, LEAST_CHARS, MAX_CHARS, MAX_REPLACED = 5_000_000, 24_000_000, 200, 24_000, 0.02
_END, _ENTRY = b"PK\x05\x06", b"PK\x01\x02"


def archive_report(data: bytes) -> dict[str, float] | None:
    """Entries and declared sizes from the directory of a zip file, nothing unpacked; None if it has none."""
    end = data.rfind(_END, max(0, len(data) - 65_557))
    if end < 0 or end + 22 > len(data):
        return None
    number, _, at = struct.unpack_from("<HII", data, end + 10)
    packed = unpacked = 0
    for _ in range(number):
        if data[at : at + 4] != _ENTRY or at + 46 > len(data):
            return None
        small, large, name, extra, note = struct.unpack_from("<IIHHH", data, at + 20)
        packed, unpacked = packed + small, unpacked + large
        at += 46 + name + extra + note
    return {"entries": number, "packed": packed, "unpacked": unpacked, "ratio": unpacked / packed if packed else 0.0}


def _inspected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        reports = [archive_report(d) if d is not None else None for d in frame["content"]]
        table = pd.DataFrame([r or {"entries": None, "packed": None, "unpacked": None, "ratio": None} for r in reports], index=frame.index)
        yield pd.concat([frame[["path"]], table], axis=1).assign(safe=[r is not None and r["unpacked"] <= MAX_UNPACKED for r in reports])


def inspect_archives(files: DataFrame) -> DataFrame:
    """path, entries, packed, unpacked, ratio, safe of files (path, content)."""
    return files.select("path", "content").mapInPandas(_inspected, "path string, entries long, packed long, unpacked long, ratio double, safe boolean")


def _docx(data: bytes) -> str | None:
    found = archive_report(data)
    if found is None or found["unpacked"] > MAX_UNPACKED:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            xml = archive.read("word/document.xml").decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile):
        return None
    return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>|<w:br\s*/>", "\n", xml))


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [_docx(d) if k == "docx" else d.decode("utf-8", "replace") for d, k in zip(frame["content"], frame["kind"], strict=True)]
        yield frame.drop(columns="content").assign(text=texts)


def extract_uploads(files: DataFrame) -> DataFrame:
    """path, kind, error, text, truncated of files (path, mime, content).

    PDF needs a library that isn't here and gives the error unsupported. Texts are tidied; under
    200 characters or with more than 2 % replacement characters they are refused; beyond 24,000
    characters they are cut and marked.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    kind = file_kind(F.col("path"), F.coalesce("mime", F.lit("-")))
    error = F.when(size == 0, "empty").when(size > MAX_BYTES, "too large").when(kind.isNull() | (kind == "pdf"), "unsupported")
    told = files.select("path", kind.alias("kind"), error.alias("error"), "content")
    read = told.filter("error is null").select("path", "kind", "content").mapInPandas(_texts, "path string, kind string, text string")
    clean = tidied(F.when(F.col("kind") == "docx", decoded(F.col("text"))).otherwise(F.col("text")))
    read = read.withColumn("text", clean)
    fault = F.when(F.col("text").isNull(), "unreadable").when(replacement_ratio(F.col("text")) > MAX_REPLACED, "not text").when(F.char_length("text") < LEAST_CHARS, "too short")
    good = read.select(
        "path", "kind", fault.alias("error"), F.when(fault.isNull(), F.substring("text", 1, MAX_CHARS)).alias("text"), (F.char_length("text") > MAX_CHARS).alias("truncated")
    )
    bad = told.filter("error is not null").select("path", "kind", "error", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated"))
    return good.union(bad)
