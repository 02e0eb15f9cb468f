"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are shuffled by a keyed hash and cut into blocks. A source of weight w is a task that wants one block
in every 1/w slots: its k-th block (from 0) is released at slot floor(k/w) and due by slot ceil((k+1)/w). Earliest deadline
first among the released blocks meets all deadlines on one line of slots, so that after any number of slots each source has
had its share to within less than one block.

Weights are exact fractions, so neither the number of sources nor the length of the line is bounded by a period. The line is
worked out on the driver, which holds a number for each source and each block, and is joined to the rows by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_KEYS, materialise


def quotas(weights: Mapping, period: int) -> dict:
    """Whole slots of each source in a period: by largest remainder, at least one each."""
    total = sum(weights.values())
    if len(weights) > period or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive, and a period must have a slot for each source")
    exact = {s: Fraction(w) / Fraction(total) * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))
    for s in order[: max(0, period - sum(out.values()))]:
        out[s] += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s], out[s] > 1, str(s)) if out[s] > 1 else (-math.inf, False, ""))] -= 1
    return out


def schedule(weights: Mapping, blocks: Mapping, on: bool = False) -> dict:
    """Slots of each source's blocks, by earliest deadline first with exact weights.

    A source whose blocks are all placed leaves the line, and slots that no other block may take yet stay empty. With
    ``on`` it goes on instead, until every source has had its own blocks.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    names = sorted(weights, key=lambda s: (s is not None, str(s)))
    exact = [Fraction(weights[s]) for s in names]
    scale = math.lcm(*(x.denominator for x in exact)) if exact else 1
    share = [int(x * scale) for x in exact]
    total = sum(share)
    wanted, left = [blocks[s] for s in names], sum(blocks[s] > 0 for s in names)
    waiting = [(0, i, 0) for i in range(len(names)) if on or wanted[i]]  # by release
    ready: list = []
    out: list = [[] for _ in names]
    slot = 0
    while left:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // share[i]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline < slot + 1:
            raise AssertionError("a deadline was missed")
        out[i].append(slot)
        left -= k + 1 == wanted[i]
        if on or k + 1 < wanted[i]:
            heapq.heappush(waiting, ((k + 1) * total // share[i], i, k + 1))
        slot += 1
    return dict(zip(names, out))


def pfair_slots(quota: Mapping) -> dict:
    """Slots of each source's blocks within one period of whole quotas."""
    return schedule(quota, quota)


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a row within its source by ``h``, with no source gathered in one task.

    Ranges of (source, h) are dealt over the partitions; the offsets of each source's parts are sums over a table of one
    row per part.
    """
    dealt = rows.repartitionByRange("source", "h").sortWithinPartitions("source", "h").withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "mix")
    part = F.shiftright("at", 33).alias("part")
    parts = dealt.groupBy("source", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    parts = materialise(parts, "mix-parts")
    few = parts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    joined = dealt.join(F.broadcast(parts) if few else parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.shiftright("at", 33) == F.col("p_part")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("p_source", "p_part", "shift", "at", "h")


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.7, source_col: str = "source", block: int = 64,
    period: int | None = None, repeat: bool = False, seed: str = "mix",
) -> DataFrame:
    """``(row, source, epoch, block, slot, place)``: the rows of ``docs`` as structs, in the mixed order of ``(slot, place)``.

    ``weights`` are the target shares by source; sources without one, and all if none are given, get their row count to
    the power ``alpha`` and divide what the given ones leave. Every row is placed
    once. A source that runs out leaves its slots empty, the others go on in proportion. With ``repeat`` it is read again
    from its start, in the same order (``epoch`` 1 and so on), until the source that is largest against its weight ends:
    then the shares hold to the end and still no row is left out.

    A null source is a source of its own; null ids and texts need no rule. Repeated rows and ties are rows like others,
    placed in an arbitrary order among themselves. An empty table gives an empty result; clashing names do no harm, as
    the row is kept as a struct. Weights are exact; only where a ``period`` is given are they rounded to its multiples.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("source", F.col("row")[source_col].cast("string"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "row"))
    spark = docs.sparkSession
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pydict()
    counts = dict(zip(found["source"], found["n"]))
    shares = target_weights(counts, weights, alpha)
    if period is not None and counts:
        shares = quotas(shares, period)
    slots = schedule(shares, {s: -(-n // block) for s, n in counts.items()}, on=repeat)
    # rows that a source must supply until the last slot that some source needs; without repetition, each row once
    supply = {s: max(n, len(slots[s]) * block) if repeat else n for s, n in counts.items()}
    number_of = {s: i for i, s in enumerate(counts)}
    plan = pa.table({
        "p_source": pa.array(counts, pa.string()), "p_id": pa.array(number_of.values(), pa.int64()),
        "n": pa.array(counts.values(), pa.int64()), "wanted": pa.array([supply[s] for s in counts], pa.int64()),
    })
    line = pa.table({
        "s_id": pa.array((number_of[s] for s, own in slots.items() for _ in own), pa.int64()),
        "s_block": pa.array((k for own in slots.values() for k in range(len(own))), pa.int64()), "slot": pa.array((t for own in slots.values() for t in own), pa.int64()),
    })

    def near(table: pa.Table) -> DataFrame:
        frame = spark.createDataFrame(table)
        return F.broadcast(frame) if table.num_rows <= BROADCAST_KEYS else frame

    out = _ranked(rows).join(near(plan), F.col("source").eqNullSafe(F.col("p_source")))
    out = out.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / F.col("n")))))
    out = out.withColumn("place", F.col("rank") + F.col("epoch") * F.col("n")).where("place < wanted")
    number: Column = F.floor(F.col("place") / block)
    out = out.withColumn("block", number).join(near(line), (F.col("p_id") == F.col("s_id")) & (F.col("block") == F.col("s_block")))
    return out.select("row", "source", "epoch", "block", "slot", (F.col("place") % block).alias("place"))


def target_weights(counts: Mapping, weights: Mapping[str, float] | None, alpha: float) -> dict:
    """Given weights are shares of the whole; the other sources divide the rest by count to the power ``alpha``."""
    given = {s: weights[s] for s in counts if weights and s in weights}
    rest = {s: n**alpha for s, n in counts.items() if s not in given}
    left = 1 - sum(given.values()) if given else 1.0
    if rest and left <= 0:
        raise ValueError("the given weights leave nothing for the other sources")
    return given | {s: x / sum(rest.values()) * left for s, x in rest.items()}
