"""Exact percentiles of all groups at once, with no group in one task.

Spark's own exact percentile keeps every different value of a group in one task, which is fine while groups are small. The
others are selected by narrowing ranges: values become 64-bit numbers of the same order, and in each of four rounds the rows
in the ranges that hold a wanted rank are counted by their next 16 bits. Counts are summed on the map side, so a range has
65,536 of them at most, and its running sums tell which range of the next round holds the rank. The last range is a value.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise

#: Rows of a group up to which one task may hold it.
SMALL = 1 << 20
_BITS = 16
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles: NaN is above all, both zeros are one."""
    values = values + 0.0
    values[np.isnan(values)] = np.nan
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ _SIGN, bits)


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ _SIGN, keys).view(np.float64)


def _mapped(rows: DataFrame, column: str, kind: str, function) -> DataFrame:
    """``rows`` with one column replaced by a numpy function of it."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array(function(b.column(at).to_numpy(zero_copy_only=False).copy()))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    fields = [f for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, schema)


def _same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names), F.lit(True))


def _selected(keys: DataFrame, groups: Sequence[str], goals: DataFrame) -> DataFrame:
    """``goals (groups, q, side, rank)`` with the ``key`` of that rank in its group."""
    goals = goals.withColumn("prefix", F.lit(0).cast("long"))
    for step in range(64 // _BITS):
        shift = 64 - _BITS * (step + 1)
        rows = keys.withColumn("prefix", F.shiftright("key", shift + _BITS) if step else F.lit(0).cast("long"))
        if step:
            rows = rows.alias("a").join(goals.select(*groups, "prefix").distinct().alias("b"), _same([*groups, "prefix"]), "left_semi")
        counts = rows.groupBy(*groups, "prefix", F.shiftright("key", shift).alias("next")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*groups, "prefix").orderBy("next"))  # 65,536 rows at most
        counts = counts.withColumn("upto", upto)
        goals = goals.alias("a").join(counts.alias("b"), _same([*groups, "prefix"]) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        rank = F.col("rank") - (F.col("upto") - F.col("n"))
        goals = materialise(goals.select(*(f"a.{g}" for g in groups), "q", "side", rank.alias("rank"), F.col("next").alias("prefix")), "percentile")
    return goals.select(*groups, "q", "side", F.col("prefix").alias("key"))


def exact_percentiles(rows: DataFrame, value: str, shares: Mapping[str, float], groups: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """``(groups, n, *shares)``: percentiles of ``value`` by linear interpolation between the two nearest ranks.

    ``shares`` names the output columns and gives their share of the rows, from 0 to 1. Nulls do not count; NaN is above all
    numbers; a null group is a group; a group of nulls alone has no row, nor has an empty table. Groups of up to ``small``
    rows are left to Spark's own function, larger ones are selected by narrowing ranges; both give the same values.
    """
    if any(not 0 <= q <= 1 for q in shares.values()):
        raise ValueError("shares must lie between 0 and 1")
    narrow = rows.select(*groups, F.col(value).cast("double").alias("__v")).where("__v is not null")
    sizes = narrow.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    at = [F.percentile("__v", F.lit(q)).alias(name) for name, q in shares.items()]
    large = materialise(sizes.where(F.col("n") > small), "percentile-groups")
    if large.isEmpty():
        return narrow.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *at).where("n > 0")

    joined = lambda how: narrow.alias("a").join(large.alias("b"), _same(groups), how)
    keys = _mapped(joined("left_semi") if groups else narrow, "__v", "long", ordered)
    keys = materialise(keys.withColumnRenamed("__v", "key"), "percentile-keys")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("q"), (F.lit(q) * (F.col("n") - 1)).alias("place")) for name, q in shares.items())))
    goals = large.select(*groups, "n", wanted.alias("w")).select(*groups, "n", "w.q", "w.place")
    sides = F.array(F.struct(F.lit("low").alias("side"), F.floor("place").alias("rank")), F.struct(F.lit("high").alias("side"), F.ceil("place").alias("rank")))
    goals = materialise(goals.withColumn("s", F.explode(sides)).select(*groups, "n", "q", "place", "s.side", "s.rank"), "percentile-goals")
    found = _mapped(_selected(keys, groups, goals.select(*groups, "q", "side", "rank")), "key", "double", doubles)
    both = goals.alias("a").join(found.alias("b"), _same([*groups, "q", "side"])).select(*(f"a.{g}" for g in groups), "n", "a.q", "place", "a.side", "key")
    end = lambda side: F.max(F.when(F.col("side") == side, F.col("key")))
    between = both.groupBy(*groups, "n", "q", "place").agg(end("low").alias("low"), end("high").alias("high"))
    part = F.col("place") - F.floor("place")
    exact = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    one = between.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("q") == name, exact)).alias(name) for name in shares))
    rest = joined("left_anti").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *at) if groups else None
    return one if rest is None else one.unionByName(rest)
