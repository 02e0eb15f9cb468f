"""Column expressions: text keys, closed vocabularies, set and salary comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(x: Column) -> Column:
    """White space of any script away from both ends."""
    return F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "")


def fold_lines(x: Column) -> Column:
    """The separators U+2028, U+2029 and U+0085 as newlines."""
    for separator in "\u2028\u2029\u0085":
        x = F.replace(x, F.lit(separator), F.lit("\n"))
    return x


def prose_key(x: Column) -> Column:
    """SHA-1 of the text with white space collapsed and letters lower-cased.

    An Arrow batch function: regular expressions of the JVM take ten times as long to collapse white space of all scripts.
    """

    @F.pandas_udf("string")
    def key(values: pd.Series) -> pd.Series:
        return values.map(lambda t: hashlib.sha1(" ".join(t.split()).lower().encode()).hexdigest(), na_action="ignore")

    return key(x)


def texts(x: Column) -> Column:
    """A list without nulls; null is the empty list."""
    return F.array_compact(F.coalesce(x, F.array().cast("array<string>")))


def text_set(x: Column) -> Column:
    return F.array_distinct(texts(x))


def set_keys(x: Column) -> Column:
    """``text_set`` by the 64-bit hashes of its terms: half the bytes in a row or less, and compared as numbers."""
    return F.array_distinct(F.transform(texts(x), lambda t: F.xxhash64(t)))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(text_set(a)) == F.array_sort(text_set(b))


def mapped(x: Column, names: Mapping[str, str], otherwise: Column | None = None) -> Column:
    pairs = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.coalesce(F.try_element_at(pairs, x), x if otherwise is None else otherwise)


def _closed(x: Column, names: Mapping[str, str], upper: bool = False) -> Column:
    key = F.lower(strip(x))
    return F.when(x != "", mapped(key, names, F.upper(strip(x)) if upper else key))


def seniority(x: Column) -> Column:
    """Canonical level; an unknown one stays, lower-cased. Null and empty are null."""
    return _closed(x, vocab.SENIORITY)


def work_mode(x: Column) -> Column:
    return _closed(x, vocab.WORK_MODE)


def currency(x: Column) -> Column:
    """Currency code; an unknown one stays, upper-cased. Null and empty are null."""
    return _closed(x, vocab.CURRENCY, upper=True)


def canonical_list(values: Column, mapper, allowed: tuple[str, ...]) -> Column:
    """Mapped values that are in the vocabulary, each once, in order of first place."""
    kept = F.filter(F.transform(texts(values), mapper), lambda v: v.isin(*allowed))
    return F.array_distinct(kept)


def title_key(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit(""))))


def amount_within(pred: Column, gold: Column, tolerance: float) -> Column:
    """``|pred - gold| <= tolerance * |gold|``; a missing gold amount wants a missing prediction."""
    near = F.abs(pred - gold) <= F.lit(tolerance) * F.abs(gold)
    return F.when(gold.isNull(), pred.isNull()).otherwise(F.coalesce(near, F.lit(False)))


def amounts_within(pred: Column, gold: Column, tolerance: float) -> Column:
    return amount_within(pred["amount_from"], gold["amount_from"], tolerance) & amount_within(pred["amount_to"], gold["amount_to"], tolerance)


def same_salary(a: Column, b: Column, tolerance: float) -> Column:
    """Both absent, or equal currency and kind and both bounds within ``tolerance`` of ``b``; the period does not count."""
    both = a["currency"].eqNullSafe(b["currency"]) & a["kind"].eqNullSafe(b["kind"]) & amounts_within(a, b, tolerance)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(both)


def rounded(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)
