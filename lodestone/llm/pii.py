"""Personal data in texts by weak supervision. DataFrame operations only.

Base patterns find emails, IP addresses, card and phone numbers. Wider patterns find candidates
beside them: spelled-out emails, phone numbers without a plus, card numbers with a wrong check
digit. On each span four labelers vote yes, no or nothing: its shape, a gazetteer (top-level
domains, issuer prefixes, address ranges, dialling lengths), the words before it and a check on
its digits. Expectation-maximisation over the votes estimates how far each labeler is to be
believed; the probabilities that result train a naive Bayes classifier of span features, which
alone decides on the candidates. Base spans always stay.

Both need only numbers of spans by votes and feature, a table of fixed size; it is all that
comes to the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. Possessive runs and the look behind change nothing in what is found (a match
#: begins where its run begins, or where the last match ended); they keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: Thirteen digits or more of [0-9]([\x20-]?[0-9])+; shorter runs fail the length anyway.
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beside the base patterns.
SPELLED_EMAIL = (
    r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\[dot\]|\(dot\)|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]++)++"
)
LOCAL_PHONE = r"(?<![0-9A-Za-z.+(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[\x20.-][0-9])"
#: Gazetteers and context words.
TOP_LEVEL = "com org net edu gov mil int info biz name pro mobi coop aero museum jobs travel dev app cloud online shop site tech blog wiki".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
CONTEXT_YES = {
    "email": r"(?i)(?:e-?mail|contact|write to|reach me)[^\n]{0,16}$",
    "ip": r"(?i)(?:\bip|host|server|address|from)[^\n]{0,16}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|payment|account)[^\n]{0,16}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax)[^\n]{0,16}$",
}
CONTEXT_NO = r"(?i)(?:version|isbn|issn|order|token|serial|licen[sc]e|invoice|\bid\b|\bno\b)[^\n]{0,8}$"
ACCEPT = 0.9
_ROUNDS = 30
_CONTEXT_CHARS = 32
_BLANK = "\x01"
#: Spans whose places are added up together.
_BLOCK = 128

_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _between(text: Column, pattern: str) -> Column:
    """What stands before each match of a pattern (gap), the match and what follows; the last item has no match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def item(items: Column) -> Column:
        after = F.slice(items, F.lit(2), F.size(items))
        return F.zip_with(items, after, lambda x, y: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), F.left(y["gap"], F.lit(1)).alias("after")))

    return _let(parts, item)


def spans_of(text: Column, pattern: str, guard: Column) -> Column:
    """start, end (code points, end exclusive), text, before and after of the matches of a pattern.

    before: up to _CONTEXT_CHARS characters since the last match; after: the next one. The text
    between matches comes from split, the matches from regexp_extract_all; their lengths add up
    to the places. Where guard is false no match is looked for.
    """
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, item: Column) -> Column:
        at = acc["at"] + F.char_length(item["gap"])
        after = at + F.coalesce(F.char_length(item["match"]), F.lit(0))
        span = F.struct(
            at.alias("start"), after.alias("end"), item["match"].alias("text"), F.right(item["gap"], F.lit(_CONTEXT_CHARS)).alias("before"), F.coalesce(item["after"], F.lit("")).alias("after")
        )
        return F.struct(after.alias("at"), F.when(item["match"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(
            block["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text"), s["before"].alias("before"), s["after"].alias("after"))
        )

    def placed(items: Column) -> Column:
        """All spans: places inside blocks of items, then the blocks' places. Appending copies a list, so lists stay short."""
        last = F.ceil(F.size(items) / _BLOCK).cast("int") - 1
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)), start, add))
        ends = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def firsts(done: Column) -> Column:
            return F.aggregate(done, ends, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

        return _let(blocks, lambda done: F.flatten(F.zip_with(done, firsts(done), moved)))

    return F.when(guard, _let(_between(text, pattern), lambda items: F.when(F.size(items) > 1, placed(items)).otherwise(none))).otherwise(none)


def blanked(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """text with the valid matches of a pattern overwritten, at the same length."""
    kept = F.transform(
        _between(text, pattern),
        lambda i: F.concat(i["gap"], F.when(i["match"].isNull(), "").when(valid(i["match"]), F.repeat(F.lit(_BLANK), F.char_length(i["match"]))).otherwise(i["match"])),
    )
    return F.array_join(kept, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(back, k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))


def _is_ip(text: Column) -> Column:
    return F.forall(_octets(text), lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


def _judged(kind: str, base: bool):
    """A function from a span to its votes and features."""

    def judge(span: Column) -> Column:
        match, false = span["text"], F.lit(False)
        digits = _digits(match)
        before, after = span["before"], span["after"]
        check, shape = F.lit(0), F.lit(1)
        if kind == "email":
            place = F.lower(F.regexp_extract(match, "([A-Za-z]+)$", 1))
            known = _vote(place.isin(TOP_LEVEL) | place.rlike("^[a-z]{2}$"), ~F.coalesce(place.rlike("^[a-z]{2,}$"), false))
            check = _vote(false, match.contains(".."))
        elif kind == "ip":
            first = F.element_at(_octets(match), 1)
            known = _vote(first.cast("int").between(1, 223) & (first != "127"), first == "0")
            check = _vote(false, match.rlike(r"(?:^|\.)0[0-9]"))
        elif kind == "card":
            known = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
            passed = luhn(digits)
            check = _vote(passed, ~passed)
            shape = F.lit(1) if base else _vote(match.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), false)
        else:
            known = _vote(F.length(digits).isin(10, 11), F.length(digits) < 9)
            shape = F.lit(1) if base else _vote(match.startswith("("), ~match.rlike(r"[(\x20-]"))
        context = _vote(before.rlike(CONTEXT_YES[kind]), before.rlike(CONTEXT_NO))
        separators = F.regexp_replace(match, "[A-Za-z0-9]", "")
        sides = [F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[A-Za-z]"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("other") for c in (F.right(before, F.lit(1)), after)]
        separator = F.when(separators == "", "none").when(separators.rlike("^-+$"), "dash").when(separators.rlike(r"^\.+$"), "dot").when(separators.rlike(r"^\x20+$"), "space").otherwise("mixed")
        features = F.array(
            F.concat(F.lit("digits="), F.least(F.length(digits), F.lit(20)).cast("string")),
            F.concat(F.lit("separator="), separator),
            F.concat(F.lit("left="), sides[0]),
            F.concat(F.lit("right="), sides[1]),
            F.concat(F.lit("context="), context.cast("string")),
            F.concat(F.lit("known="), known.cast("string")),
            F.concat(F.lit("check="), check.cast("string")),
        )
        return F.struct(
            F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.lit(base).alias("base"),
            F.concat_ws(",", *[v.cast("string") for v in (shape, known, context, check)]).alias("votes"), features.alias("features"),
        )

    return judge


def judged_spans(documents: DataFrame) -> DataFrame:
    """row (all columns of documents) and found: all base spans and candidates, with votes and features.

    Base spans come first, by kind as listed and then by start. Candidates that overlap one are left out.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")

    def is_card(match: Column) -> Column:
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))

    def is_phone(match: Column) -> Column:
        return F.length(_digits(match)).between(9, 15)

    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), F.coalesce(documents["text"].cast("string"), F.lit("")).alias("text"))
    based = whole.select(
        "row", "text",
        spans_of(text, EMAIL, text.contains("@")).alias("email"),
        F.filter(spans_of(text, IP, digit & text.contains(".")), lambda s: _is_ip(s["text"])).alias("ip"),
        F.filter(spans_of(text, CARD, digit), lambda s: is_card(s["text"])).alias("card"),
        F.filter(spans_of(text, PHONE, text.contains("+")), lambda s: is_phone(s["text"])).alias("phone"),
    )
    # candidates are looked for in the text without base spans, one kind after the other
    free = text
    for kind, pattern, valid in (("email", EMAIL, lambda m: F.lit(True)), ("phone", PHONE, is_phone), ("card", CARD, is_card), ("ip", IP, _is_ip)):
        based = based.withColumn("free", F.when(F.size(kind) > 0, blanked(free, pattern, valid)).otherwise(free))
        free = F.col("free")
    looked = based.select(
        "*",
        spans_of(free, SPELLED_EMAIL, text.rlike(r"(?i)\bdot\b")).alias("spelled"),
        F.filter(spans_of(free, CARD, digit), lambda s: F.length(_digits(s["text"])).between(13, 19)).alias("wrong"),
        spans_of(free, LOCAL_PHONE, digit).alias("local"),
    )
    return looked.select(
        "row",
        "text",
        F.concat(
            *[F.transform(k, _judged(k, True)) for k in KINDS],
            F.transform("spelled", _judged("email", False)),
            F.transform("wrong", _judged("card", False)),
            F.transform("local", _judged("phone", False)),
        ).alias("found"),
    )


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], float], rounds: int = _ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """The probability that a span is personal data, by kind and votes: expectation-maximisation.

    For each kind, how often each labeler says yes, no or nothing is estimated for spans that
    are and that aren't, together with their share. It starts from the votes, where a no weighs twice.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = {v: n for (k, v), n in counts.items() if k == kind}
        likely = {v: 1 / (1 + math.exp(-1.5 * (sum(v) - v.count(-1)))) for v in rows}
        for _ in range(rounds):
            share = (1 + sum(n * likely[v] for v, n in rows.items())) / (2 + sum(rows.values()))
            said: dict[tuple[int, int, bool], float] = defaultdict(lambda: 1.0)
            for v, n in rows.items():
                for labeler, vote in enumerate(v):
                    said[labeler, vote, True] += n * likely[v]
                    said[labeler, vote, False] += n * (1 - likely[v])
            whole = {(j, y): sum(said[j, vote, y] for vote in (-1, 0, 1)) for j in range(4) for y in (True, False)}
            for v in rows:
                odds = math.log(share / (1 - share))
                for labeler, vote in enumerate(v):
                    odds += math.log(said[labeler, vote, True] / whole[labeler, True]) - math.log(said[labeler, vote, False] / whole[labeler, False])
                likely[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        out |= {(kind, v): p for v, p in likely.items()}
    return out


def span_classifier(judged: DataFrame) -> dict[str, float]:
    """Log odds by "kind" (its prior) and "kind|feature", trained on the spans of judged."""
    # outer: for a plain explode Spark would look for the spans once more in a filter below it, written out in full
    spans = judged.select(F.explode_outer("found").alias("s")).filter("s is not null")
    votes = spans.select("s.kind", "s.votes", F.explode(F.concat(F.array(F.lit("")), "s.features")).alias("feature"))
    rows = votes.groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")).collect()
    parsed = [(r["kind"], tuple(map(int, r["votes"].split(","))), r["feature"], r["n"]) for r in rows]
    likely = reliabilities({(k, v): n for k, v, f, n in parsed if f == ""})
    sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for kind, v, feature, n in parsed:
        sums[kind, feature][0] += n * likely[kind, v]
        sums[kind, feature][1] += n * (1 - likely[kind, v])
    odds: dict[str, float] = {}
    for (kind, feature), (yes, no) in sums.items():
        all_yes, all_no = sums[kind, ""]
        if feature == "":
            odds[kind] = math.log((yes + 0.5) / (no + 0.5))
        else:  # drawn to how often the feature is there at all, so that what was hardly seen says nothing
            often = (yes + no) / (all_yes + all_no)
            odds[f"{kind}|{feature}"] = math.log((yes + often) / (all_yes + 1)) - math.log((no + often) / (all_no + 1))
    return odds


def _accepted(odds: dict[str, float]):
    weights = F.create_map(*[F.lit(x) for item in sorted(odds.items()) for x in item]) if odds else F.create_map().cast("map<string,double>")

    def weight(name: Column) -> Column:
        return F.coalesce(F.try_element_at(weights, name), F.lit(0.0))

    def accept(span: Column) -> Column:
        total = F.aggregate(span["features"], weight(span["kind"]), lambda t, f: t + weight(F.concat(span["kind"], F.lit("|"), f)))
        return span["base"] | (total > math.log(ACCEPT / (1 - ACCEPT)))

    return accept


def find_personal_data(documents: DataFrame) -> DataFrame:
    """documents (text and any other columns) with spans: array of kind, start, end, base. A column spans there is replaced.

    Spans are in order of kind as listed, then of start. Null texts count as empty and have no
    spans. Texts are read whole; repeated rows stay repeated; an empty table gives an empty result.
    """
    judged = judged_spans(documents)
    odds = span_classifier(judged)
    place = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    kept = F.transform(
        F.filter("found", _accepted(odds)),
        lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")),
    )
    return judged.select(*[F.col("row")[c].alias(c) for c in documents.columns if c != "spans"], F.array_sort(kept).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; spans that overlap become one."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(by_start, start, add, lambda acc: F.array_join(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def span_string(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
