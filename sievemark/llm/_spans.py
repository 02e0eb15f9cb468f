"""Positions and replacements of regular-expression matches as column expressions.

``regexp_extract_all`` gives the leftmost non-overlapping matches and ``split`` the pieces between them; the lengths of both
give every match its place in code points. No Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, not wherever a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda s, v: s + v)


def located(text: Column, pattern: str) -> Column:
    """``array<struct<begin, value>>`` of the matches; ``begin`` counts code points from 0.

    A match begins after all pieces and matches before it. These lengths are added up in groups of about the root of their
    number, first within groups and then over groups, so that texts of very many matches take no time of their square.
    """

    def places(lengths: Column, found: Column, first: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))

        def grouped(width: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(lengths), width), lambda i: i < F.size(lengths))
            sums = F.transform(starts, lambda i: _total(F.slice(lengths, i + 1, width)))

            def placed(before: Column) -> Column:
                def begin(i: Column) -> Column:
                    group = F.floor(i / width).cast("int")
                    return F.get(before, group) + _total(F.slice(lengths, group * width + 1, i - group * width)) + F.get(first, i)

                return F.transform(found, lambda m, i: F.struct(begin(i).alias("begin"), m.alias("value")))

            return bound(bound(sums, lambda own: F.transform(own, lambda _, g: _total(F.slice(own, F.lit(1), g)))), placed)

        return bound(step, grouped)

    def of(found: Column) -> Column:
        def with_pieces(first: Column) -> Column:
            both = F.zip_with(first, found, lambda p, m: p + F.length(m))
            return bound(both, lambda lengths: places(lengths, found, first))

        none = F.array().cast("array<struct<begin:int,value:string>>")
        between = F.transform(F.slice(pieces(text, pattern), F.lit(1), F.size(found)), lambda p: F.length(p))
        return F.when(F.size(found) == 0, none).otherwise(bound(between, with_pieces))

    return bound(matches(text, pattern), of)


def rewritten_by(text: Column, pattern: str, new: Column) -> Column:
    """``text`` with its matches replaced, one after the other, by the strings of the array ``new``."""
    return F.array_join(F.zip_with(pieces(text, pattern), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
