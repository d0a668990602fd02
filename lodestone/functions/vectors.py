"""Column expressions on vectors: arrays of float, sums in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once for a row even where body uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length 1; as it is if its length is 0, not finite, or 1 already (within 1e-6)."""

    def scaled(row: Column) -> Column:
        v, size = row["v"], row["size"]
        keep = (size == 0) | F.isnan(size) | (size == float("inf")) | (F.abs(size - 1) < 1e-6)
        return F.when(keep, v).otherwise(F.transform(v, lambda x: (x / size).cast("float")))

    return let(F.struct(v.alias("v"), norm(v).alias("size")), scaled)


def scale_of(v: Column) -> Column:
    """The step of the int8 form: the largest component over 127, 1 for a zero vector."""
    top = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127)


def quantized(v: Column) -> Column:
    """struct(q, scale): components as steps, halves up; scale is stored as float."""

    def steps(row: Column) -> Column:
        q = F.transform(row["v"], lambda x: F.floor(x.cast("double") / row["step"] + 0.5).cast("tinyint"))
        return F.struct(q.alias("q"), row["step"].cast("float").alias("scale"))

    return let(v, lambda w: let(F.struct(w.alias("v"), scale_of(w).alias("step")), steps))


def dequantized(q: Column) -> Column:
    return let(q, lambda r: F.transform(r["q"], lambda x: (x.cast("double") * r["scale"].cast("double")).cast("float")))
