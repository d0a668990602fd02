"""Answers of models that have to fit a schema: the schema for the call, the check, one repair, quarantine.

A schema is a StructType. What a field must satisfy beyond its type stands in its metadata, so one
object gives the type of the parsed answer, the schema that a model is called with, and the check.
"""

from __future__ import annotations

from collections.abc import Callable
from json import JSONDecoder
from math import floor, inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, StringType, StructField, StructType

from lodestone.functions.text import json_begun
from lodestone.session import written

#: Issues that a repair is told of, and characters of the reply that it is shown.
TOLD, SHOWN_CHARS = 12, 4000
_DECODER = JSONDecoder()
RULES = ("description", "one_of", "least_chars", "most_chars", "least", "most", "least_items", "most_items")


def field(name: str, kind: DataType, optional: bool = False, **rules) -> StructField:
    """A field with rules: one_of, least_chars, most_chars for texts, least, most for numbers, least_items, most_items for lists, description."""
    if unknown := set(rules) - set(RULES):
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    return StructField(name, kind, optional, rules)


def json_schema(kind: DataType, rules: dict | None = None) -> dict:
    """The schema for a model call: type, description, enum, items, properties, required.

    Only objects, lists, texts, numbers and booleans can be said; anything else is an error that
    names the type. A list of required fields is left out where it would be empty.
    """
    rules = rules or {}
    said = {"description": rules["description"]} if "description" in rules else {}
    if isinstance(kind, StringType):
        return {"type": "string", **({"enum": list(rules["one_of"])} if "one_of" in rules else {}), **said}
    if isinstance(kind, BooleanType):
        return {"type": "boolean", **said}
    if isinstance(kind, IntegralType):
        return {"type": "integer", **said}
    if isinstance(kind, FractionalType):
        return {"type": "number", **said}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType), **said}
    if isinstance(kind, StructType):
        required = [f.name for f in kind if not f.nullable]
        return {"type": "object", "properties": {f.name: json_schema(f.dataType, f.metadata) for f in kind}, **({"required": required} if required else {}), **said}
    raise ValueError(f"a model schema can't say {kind.simpleString()}: use an object, list, text, number or boolean")


def _checker(kind: DataType, rules: dict) -> Callable[[object], list[str]]:
    """Tells what is wrong with a parsed value that is there, as texts that go on from its path."""
    if isinstance(kind, StructType):
        fields = [(f.name, _checker(f.dataType, f.metadata), f.nullable) for f in kind]

        def of_object(value: object) -> list[str]:
            if type(value) is not dict:
                return [": an object is asked for"]
            out = []
            for name, check, optional in fields:
                inner = value.get(name)
                if inner is not None:
                    out += [f".{name}{t}" for t in check(inner)]
                elif not optional:
                    out.append(f".{name}: missing")
            return out

        return of_object
    if isinstance(kind, ArrayType):
        check, fewest, most = _checker(kind.elementType, {}), rules.get("least_items", 0), rules.get("most_items", 1 << 30)

        def of_list(value: object) -> list[str]:
            if type(value) is not list:
                return [": a list is asked for"]
            out = [": too few items"] if len(value) < fewest else [": too many items"] if len(value) > most else []
            for k, item in enumerate(value):
                out += [f".{k}{t}" for t in check(item)]
            return out

        return of_list
    if isinstance(kind, StringType):
        shortest, longest, allowed = rules.get("least_chars", 0), rules.get("most_chars", 1 << 30), rules.get("one_of")

        def of_text(value: object) -> list[str]:
            if type(value) is not str:
                return [": a text is asked for"]
            out = [": too short"] if len(value) < shortest else [": too long"] if len(value) > longest else []
            return out if allowed is None or value in allowed else [*out, ": not one of the allowed values"]

        return of_text
    if isinstance(kind, BooleanType):
        return lambda value: [] if type(value) is bool else [": true or false is asked for"]
    least, largest, whole = rules.get("least", -inf), rules.get("most", inf), isinstance(kind, IntegralType)

    def of_number(value: object) -> list[str]:
        if type(value) is not int and type(value) is not float:
            return [": a number is asked for" if not whole else ": a whole number is asked for"]
        if whole and not (-(1 << 63) <= value <= 1 << 63 and value == floor(value)):
            return [": a whole number is asked for"]
        return [": too small"] if value < least else [": too large"] if value > largest else []

    return of_number


def _decoded(text: str) -> object:
    return _DECODER.raw_decode(text)[0]


def _issues(schema: StructType) -> Callable[[Column], Column]:
    """What is wrong with a text that begins with JSON, as texts path: message; null for a null."""
    check = _checker(schema, {})

    def one(text: str | None) -> list[str] | None:
        try:
            return None if text is None else [t[1:] if t.startswith(".") else f"(root){t}" for t in check(_decoded(text))]
        except ValueError:
            return None

    @pandas_udf(ArrayType(StringType()))
    def issues(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return issues


def checked(replies: DataFrame, schema: StructType) -> DataFrame:
    """replies (reply and others) with issues, valid and value.

    The JSON is taken from the reply as extracted_json() does; what follows its end is not looked
    at. issues are texts such as "findings.0.status: missing"; a reply without JSON has the one of
    the root. value is the answer as a struct of schema, null unless there are no issues; fields
    that the schema doesn't know are left out.
    """
    begun = replies.withColumn("_json", json_begun(F.col("reply")))
    json = F.when(F.try_parse_json("_json").isNotNull(), F.col("_json"))
    told = begun.withColumn("issues", F.coalesce(_issues(schema)(json), F.array(F.lit("(root): no JSON"))))
    told = told.withColumn("valid", F.size("issues") == 0)
    return told.withColumn("value", F.when(F.col("valid"), F.from_json("_json", schema))).drop("_json")


def repair_prompt(prompt: Column, reply: Column, issues: Column) -> Column:
    """The prompt of the second call: the first one, the reply that was wrong, and what is wrong with it."""
    listed = F.array_join(F.transform(F.slice(issues, 1, TOLD), lambda i: F.concat(F.lit("- "), i)), "\n")
    return F.concat(
        prompt, F.lit("\n\nThe last reply does not fit the schema that was asked for.\n\nIt was:\n"), F.substring(reply, 1, SHOWN_CHARS),
        F.lit("\n\nWhat is wrong with it:\n"), listed, F.lit("\n\nAnswer with the corrected JSON and nothing else."),
    )


def answered(calls: DataFrame, schema: StructType, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """call_id, attempts, valid, issues, value of calls (call_id, prompt): each is made once, and once more with a
    repair prompt if the answer doesn't fit schema.

    model gives the replies (call_id, reply) to calls (call_id, prompt, attempt); one without a
    reply counts as one without JSON. Replies are written before they are looked at, so no call is
    made twice for one attempt. Rows that aren't valid in the end are the quarantine.
    """

    def replies_to(asked: DataFrame, attempt: int) -> DataFrame:
        made = model(asked.withColumn("attempt", F.lit(attempt))).select("call_id", "reply")
        return asked.join(made, "call_id", "left").withColumn("attempts", F.lit(attempt))

    first = written(checked(written(replies_to(calls.select("call_id", "prompt"), 1), "replies"), schema), "checked-answers")
    again = first.filter("not valid").select("call_id", repair_prompt(F.col("prompt"), F.coalesce("reply", F.lit("")), F.col("issues")).alias("prompt"))
    second = checked(written(replies_to(again, 2).drop("prompt"), "replies"), schema)
    said = ("call_id", "attempts", "valid", "issues", "value")
    return first.filter("valid").select(*said).union(second.select(*said))
