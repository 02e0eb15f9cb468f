"""Bootstrap intervals as weighted sums: every metric is a function of sums over records, so a resample is a set of weights."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.columns import rounded
from .scoring import COUNTS, ratios, set_contributions

#: Records whose draws are made together, and resamples that are multiplied at once.
CHUNK, AT_ONCE = 8192, 32


def _stream(*parts) -> np.random.RandomState:
    """A stream of random numbers that stays the same in all versions of numpy."""
    return np.random.RandomState(np.frombuffer(hashlib.md5(":".join(map(str, parts)).encode()).digest(), np.uint32))


def _falling(n: int, at: int, resamples: range, seed: str, chunk: int) -> np.ndarray:
    """How many of the n draws of each resample fall on chunk ``at``.

    The chunks are halved from all of them down to this one, and the draws with them by a binomial draw that every task on
    the way makes alike: no draw has to be sent anywhere, and a task's work grows with the logarithm of the chunks.
    """
    low, high, draws = 0, -(-n // chunk), np.full(len(resamples), n)
    while high - low > 1:
        mid = (low + high) // 2
        share = (mid - low) * chunk / (min(high * chunk, n) - low * chunk)
        first = _stream(seed, resamples.start, low, high).binomial(draws, share)
        low, high, draws = (low, mid, first) if at < mid else (mid, high, draws - first)
    return draws


def _weights(n: int, at: int, resamples: range, seed: str, chunk: int) -> np.ndarray:
    """How often each record of chunk ``at`` is in each resample: its draws fall evenly on its records."""
    size, draws = min(chunk, n - at * chunk), _falling(n, at, resamples, seed, chunk)
    drawn = _stream(seed, resamples.start, at).randint(size, size=draws.sum(), dtype=np.int32) + np.repeat(np.arange(len(draws)) * size, draws)
    return np.bincount(drawn, minlength=len(draws) * size).reshape(len(draws), size).astype(float)


def resampled(rows: DataFrame, ids: DataFrame, resamples: int, seed: str, id_col: str = "offer_id", chunk: int = CHUNK) -> DataFrame:
    """``(variant, b, headline_f1, validity)``; every variant and resample has its row, all variants have the same draws.

    ``ids`` has a dense ``pos`` from 0. What a record adds to the sums is worked out once; a chunk of records is multiplied
    with its weights in all resamples, and only those sums are shuffled.
    """
    if resamples < 1:
        raise ValueError("at least one resample")
    n = ids.count()
    if not n:
        raise ValueError("no gold records")
    counts = set_contributions(rows, vocab.HEADLINE_FIELDS).join(ids.select("pos", id_col), id_col)
    added = [F.sum(f"c.{c}").alias(c) for c in COUNTS] + [F.sum(F.col("valid").cast("long")).alias("n_valid"), F.count(F.lit(1)).alias("n")]
    counts = counts.groupBy("pos", "variant", F.col("c.field").alias("field")).agg(*added)
    names = [*COUNTS, "n_valid", "n"]

    def sums(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at = int(key[0])
        groups = part.groupby(["variant", "field"], sort=True)
        size, made = min(chunk, n - at * chunk), []
        table = np.zeros((size, groups.ngroups, len(names)))
        table[part["pos"] - at * chunk, groups.ngroup()] = part[names]
        for first in range(0, resamples, AT_ONCE):
            bs = range(first, min(first + AT_ONCE, resamples))
            total = (_weights(n, at, bs, seed, chunk) @ table.reshape(size, -1)).reshape(len(bs) * groups.ngroups, -1)
            made.append(pd.DataFrame(total, columns=names).assign(b=np.repeat(bs, groups.ngroups)))
        out = pd.concat(made, ignore_index=True)
        keys = list(groups.groups) * resamples
        return out.assign(variant=[k[0] for k in keys], field=[k[1] for k in keys]).astype(dict.fromkeys(names, "int64"))

    schema = ", ".join(f"{c} long" for c in names) + ", b long, variant string, field string"
    total = counts.groupBy(F.floor(F.col("pos") / chunk).alias("chunk")).applyInPandas(sums, schema)
    total = total.groupBy("variant", "b", "field").agg(*(F.sum(c).alias(c) for c in names))
    validity = F.coalesce(F.try_divide(F.max("n_valid").cast("double"), F.max("n")), F.lit(0.0))
    return ratios(total).groupBy("variant", "b").agg(rounded(F.avg("f1")).alias("headline_f1"), rounded(validity).alias("validity"))


def intervals(metrics: DataFrame, ci: float = 95.0) -> DataFrame:
    """Percentile intervals by variant; nulls are left out."""
    if not 0 < ci < 100:
        raise ValueError("ci must lie between 0 and 100")
    low = (100 - ci) / 200
    pick = lambda c, q: rounded(F.percentile(c, F.lit(q)))
    return metrics.groupBy("variant").agg(
        pick("headline_f1", low).alias("f1_low"), pick("headline_f1", 1 - low).alias("f1_high"),
        pick("validity", low).alias("validity_low"), pick("validity", 1 - low).alias("validity_high"),
    )


def paired_differences(metrics: DataFrame, reference: str, ci: float = 95.0) -> DataFrame:
    """Differences to the reference variant on the same resamples: interval, whether it excludes 0, and agreement in sign."""
    low = (100 - ci) / 200
    base = metrics.where(F.col("variant") == reference).select("b", F.col("headline_f1").alias("r_f1"), F.col("validity").alias("r_v"))
    both = metrics.where(F.col("variant") != reference).join(base, "b")
    spread = F.explode(
        F.array(
            F.struct(F.lit("headline_f1").alias("metric"), (F.col("headline_f1") - F.col("r_f1")).alias("d")),
            F.struct(F.lit("validity").alias("metric"), (F.col("validity") - F.col("r_v")).alias("d")),
        )
    )
    diffs = both.select("variant", spread.alias("x")).select("variant", "x.*")
    out = diffs.groupBy("variant", "metric").agg(
        rounded(F.percentile("d", F.lit(low))).alias("low"), rounded(F.percentile("d", F.lit(1 - low))).alias("high"),
        rounded(F.avg((F.col("d") > 0).cast("double"))).alias("share_above"), rounded(F.avg((F.col("d") < 0).cast("double"))).alias("share_below"),
        rounded(F.avg((F.col("d") == 0).cast("double"))).alias("share_same"),
    )
    return out.withColumn("separated", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def separation(metrics: DataFrame, points: DataFrame, ci: float = 95.0) -> DataFrame:
    """Differences of the other variants to the best one, by variant and metric.

    ``points (variant, pos, headline_f1, validity, coverage)`` has what was observed. The best has the largest F1, the
    first by ``pos`` on ties; without any F1 there are no rows. Two variants are comparable if both answer every record, and
    separated if they are and the interval leaves out 0. ``sign_agreement`` is the share of resamples on the observed side
    of 0; where 0 was observed, of those that are 0 too.
    """
    best = points.where("headline_f1 is not null").orderBy(F.desc("headline_f1"), "pos").limit(1).collect()
    reference = best[0]["variant"] if best else None
    found = paired_differences(metrics, reference, ci)
    spread = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in ("headline_f1", "validity"))))
    own = points.select("variant", "coverage", spread.alias("x")).select("variant", "coverage", "x.*")
    base = own.where(F.col("variant") == F.lit(reference)).select("metric", F.col("point").alias("r_point"), F.col("coverage").alias("r_coverage"))
    found = found.join(own, ["variant", "metric"]).join(F.broadcast(base), "metric")  # two rows
    observed = F.round(F.col("point") - F.col("r_point"), 12)
    sign = F.when(observed > 0, F.col("share_above")).when(observed < 0, F.col("share_below")).otherwise(F.col("share_same"))
    comparable = (F.col("coverage") >= 1) & (F.col("r_coverage") >= 1)
    return found.select(
        F.lit(reference).alias("reference"), "variant", "metric", rounded(observed).alias("observed"), "low", "high",
        F.coalesce(sign, F.lit(0.0)).alias("sign_agreement"), comparable.alias("comparable"), (comparable & F.col("separated")).alias("separated"),
    )
