"""Column expressions on texts: terms, estimates, names, cleaning, classification."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The words and suffixes that the tokenizer drops, and its pattern.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "at", "by", "with", "as", "is", "are", "was", "were", "be", "been",
    "that", "this", "these", "those", "it", "its", "from", "which", "such", "any",
)
SUFFIXES = ("ations", "ation", "ing", "ies", "ed", "es", "s")
TERM = r"[a-z0-9]+(?:\.[a-z0-9]+)*"
TOKENS_PER_WORD = 1.3
SLUG_CHARS = 60

# Substrings that name the kind of a failure, in the order in which they are tried.
FAILURE_RULES = (
    ("model-budget", ("prepayment credits", "credits are depleted", "billing", "quota exceeded", "exceeded your current quota")),
    ("model-busy", ("resource_exhausted", "(429)", "429 ")),
    ("model-auth", ("api_key", "api key", "permission_denied", "unauthenticated", "(401)", "(403)")),
    ("model-timeout", ("timeout", "timed out", "etimedout")),
)


def trimmed(text: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def stem(term: Column) -> Column:
    """term without the first suffix that leaves three characters or more; ies becomes y."""
    out = F
    for suffix in SUFFIXES:
        fits = term.endswith(suffix) & (F.length(term) - len(suffix) >= 3) & (F.length(term) > 3)
        base = F.substring(term, F.lit(1), F.length(term) - len(suffix))
        out = out.when(fits, F.concat(base, F.lit("y")) if suffix == "ies" else base)
    return out.otherwise(term)


def terms(text: Column) -> Column:
    """The stemmed terms of a text, stopwords left out, in order. Null gives null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.transform(F.filter(found, lambda t: ~t.isin(*STOPWORDS)), stem)


@lru_cache(maxsize=1 << 18)
def term_of(raw: str) -> str | None:
    """The term of one match of TERM, as terms() has it; null for a stopword."""
    if raw in STOPWORDS:
        return None
    for suffix in SUFFIXES:
        if len(raw) > 3 and raw.endswith(suffix) and len(raw) - len(suffix) >= 3:
            return raw[: -len(suffix)] + "y" * (suffix == "ies")
    return raw


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimated_tokens(text: Column) -> Column:
    """Words times 1.3, rounded up, in double precision."""
    return F.ceil(F.size(words(text)) * TOKENS_PER_WORD).cast("int")


def usage_estimate(text: Column) -> Column:
    """Tokens to bill for a text: three quarters of its words, rounded up."""
    return F.ceil(F.size(words(text)) * 0.75).cast("int")


def slug(value: Column) -> Column:
    """Lower case, other characters than letters and digits as one dash, at most 60 characters."""
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, SLUG_CHARS)


def chunk_id(framework: Column, citation: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", slug(framework), slug(citation), ordinal.cast("string"))


def embedding_text(framework: Column, citation: Column, heading: Column, text: Column) -> Column:
    """What is embedded for a chunk: its place, its heading and its text."""
    return F.concat(framework, F.lit(" — "), citation, F.lit("\n"), heading, F.lit("\n\n"), text)


def indexed_text(citation: Column, heading: Column, text: Column) -> Column:
    return F.concat_ws("\n", citation, heading, text)


def folded(text: Column) -> Column:
    """A text as quotes are compared: lower case, plain quotes and dashes, single spaces."""
    marks = "‘’‛“”‐‑‒–—―− "
    plain = F.translate(F.lower(text), marks, "'''" + '""' + "-" * 7 + " ")
    return trimmed(F.regexp_replace(plain, r"(?U)\s+", " "))


def quote_tokens(text: Column) -> Column:
    """Tokens for the overlap of quotes: runs of letters and digits, nothing dropped."""
    return F.filter(F.split(folded(text), "[^a-z0-9]+"), lambda t: t != "")


def tidied(text: Column) -> Column:
    """Line ends, trailing blanks, blank lines and runs of blanks reduced, in this order."""
    steps = ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
    return trimmed(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


def replacement_ratio(text: Column) -> Column:
    """The share of U+FFFD among the characters; 0 for an empty text."""
    return F.regexp_count(text, F.lit("�")) / F.greatest(F.char_length(text), F.lit(1))


def decoded(text: Column) -> Column:
    """Character references decoded one kind after another: numbers, then names, &amp; before &lt;."""

    def number(t: Column, pattern: str, base: int) -> Column:
        # pieces between references, and the references as characters, put together again
        refs = F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        chars = F.transform(refs, lambda r: _character(F.conv(r, base, 10).cast("long")))
        pieces = F.split(t, pattern, -1)
        joined = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), chars.alias("c")), lambda z: F.concat(z["p"], F.coalesce(z["c"], F.lit("")))), "")
        return F.when(t.contains("&#"), joined).otherwise(t)

    text = number(number(text, "&#x([0-9A-Fa-f]+);", 16), "&#([0-9]+);", 10)
    for name, char in (("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _character(point: Column) -> Column:
    """The character of a code point, through its UTF-8 bytes."""

    def byte(shift: int, mask: int, head: int) -> Column:
        return F.lpad(F.hex(F.shiftright(point, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(head))), 2, "0")

    one, two = byte(0, 127, 0), F.concat(byte(6, 31, 192), byte(0, 63, 128))
    three = F.concat(byte(12, 15, 224), byte(6, 63, 128), byte(0, 63, 128))
    four = F.concat(byte(18, 7, 240), byte(12, 63, 128), byte(6, 63, 128), byte(0, 63, 128))
    coded = F.when(point < 128, one).when(point < 2048, two).when(point < 65536, three).otherwise(four)
    return F.decode(F.unhex(coded), "UTF-8")


def stripped(markup: Column) -> Column:
    """Text of markup: tags become spaces, then references are decoded, then blanks are reduced."""
    return trimmed(F.regexp_replace(decoded(F.regexp_replace(markup, "<[^>]+>", " ")), r"(?U)\s+", " "))


def failure_kind(message: Column) -> Column:
    """The kind of a failure by what its message says; the first rule that fits wins."""
    low, out = F.lower(message), F
    for kind, parts in FAILURE_RULES:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(p) for p in parts]), kind)
    return out.otherwise("unknown")


# Extensions of text files, and types of files by kind.
TEXT_EXTENSIONS = r"\.(txt|md|markdown|json|csv)$"
TEXT_TYPES = ("text/plain", "text/markdown", "text/x-markdown", "application/json", "")
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def file_kind(name: Column, mime: Column) -> Column:
    """pdf, docx or text by extension, then by type; null for what can't be read."""
    low = F.lower(name)
    return (
        F.when(low.endswith(".pdf") | (mime == "application/pdf"), "pdf")
        .when(low.endswith(".docx") | (mime == DOCX_TYPE), "docx")
        .when(low.rlike(TEXT_EXTENSIONS) | mime.isin(*TEXT_TYPES), "text")
    )


def visitor_key(forwarded: Column, real_ip: Column) -> Column:
    """The first forwarded address, else the real one, else unknown."""
    first = F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real_ip), F.lit("")), F.lit("unknown"))


def _balanced(body: str) -> str:
    """From the first bracket to the one that closes it, brackets in strings not counted; what follows if none does."""
    start = min((k for k in (body.find("{"), body.find("[")) if k >= 0), default=-1)
    if start < 0:
        return body
    left, right = body[start], "}" if body[start] == "{" else "]"
    depth = 0
    for token in re.finditer(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}\[\]]', body[start:], re.S):
        depth += (token[0] == left) - (token[0] == right)
        if depth == 0:
            return body[start : start + token.end()]
    return body[start:]


@pandas_udf(StringType())
def extracted_json(texts: pd.Series) -> pd.Series:
    """The JSON in a model's answer: of the fenced block or else the whole, from the first bracket to its match. Null without a bracket."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
        found = _balanced((fenced[1] if fenced else text).strip())
        return found if found[:1] in ("{", "[") else None

    return texts.map(one)


def json_begun(text: Column) -> Column:
    """What extracted_json() finds and all that follows it, for parsers that stop at the end of a value. Null without a bracket."""
    parts = F.split(text, "```", 3)
    body = F.when(text.contains("```"), F.when(F.size(parts) == 3, parts[1]).otherwise(text)).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(?s)[{\[].*", 0), F.lit(""))


def percent(value: Column, places: int = 1) -> Column:
    """A share as percent, such as 12.5%."""
    return F.format_string(f"%.{places}f%%", value * 100)


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def safe_identifier(name: Column) -> Column:
    """Whether a name can stand in a statement: lower case, digits and underscores, no digit first."""
    return F.coalesce(name.rlike(r"\A[a-z_][a-z0-9_]*\z"), F.lit(False))


def rounded(value: Column, places: int = 6) -> Column:
    """value to so many places, halves up; the same in every engine."""
    scale = 10.0**places
    return F.floor(value * scale + 0.5) / scale
