"""Arrays and texts in DataFrame functions only, without steps that are quadratic in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a chunk of text.
CHUNK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array, in rounds of doubling distance."""

    def rounds(v):
        size = F.size(v)
        steps = F.transform(
            F.sequence(F.lit(0), F.ceil(F.log2(size.cast("double"))).cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int")
        )
        return F.aggregate(
            F.when(size > 1, steps).otherwise(F.array().cast("array<int>")),
            v,
            lambda acc, step: F.transform(acc, lambda x, i: F.when(i >= step, op(F.get(acc, i - step), x)).otherwise(x)),
        )

    return let(values, rounds)


def add(a: Column, b: Column) -> Column:
    return a + b


def chunks(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, for :func:`cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (counted from 0), found without passing what stands before."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor((start + length) / CHUNK).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.substr(part, (start - first * CHUNK + 1).cast("int"), length.cast("int"))
