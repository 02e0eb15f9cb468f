"""Similarity join of short terms with a dictionary, without comparing all pairs.

The ratio of two terms is 200 times their longest common subsequence over the sum of their lengths. A pair that reaches a
threshold shares many bigrams: a subsequence of length m leaves at least ``3 m + 1 - sum of lengths`` of the bigrams of the
terms, each padded at both ends, untouched. Two sets with so many common members share one among the first few of either in
any fixed order. So each side is known by those few bigrams, terms that share one are candidates if enough can be common from
there on, and only candidates are compared in full. No pair that reaches the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

#: Below it a pair may share no bigram at all.
LEAST_THRESHOLD = 70.0


def ratio(a: str, b: str) -> float:
    """Bit by bit: the zeros left in the row of the usual table are the subsequence; two empty texts are equal."""
    if not a or not b:
        return 100.0 * (a == b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        own = row & places.get(c, 0)
        row = (row + own | row - own) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def bigrams(term: Column) -> Column:
    """Bigrams of the padded term; of equal ones each has its number, so that they are a set."""
    padded = F.concat(F.lit("\x02"), term, F.lit("\x03"))
    plain = F.transform(F.sequence(F.lit(1), F.length(term) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    listed = F.array_sort(plain)
    places = F.sequence(F.lit(1), F.size(listed))
    return F.zip_with(listed, places, lambda g, i: F.concat(g, (i - F.array_position(listed, g)).cast("string")))


def _known_by(term: Column, threshold: float) -> Column:
    """The first bigrams, of which a similar term shares one, in the order of their hashes; those of an end, which many terms
    share, come last."""  # noqa: D205
    n = F.length(term)
    shortest = F.ceil(n * (threshold / (200.0 - threshold)) - 1e-9)  # of a term that is similar
    common = F.ceil((n + shortest) * (3.0 * threshold / 200.0 - 1.0) + 1 - 1e-9)
    ranked = lambda g: F.struct(F.rlike(g, F.lit("[\x02\x03]")).alias("end"), F.xxhash64(g).alias("hash"))
    return F.slice(F.array_sort(F.transform(bigrams(term), ranked)), 1, F.greatest(n + 2 - common, F.lit(1)).cast("int"))


def candidates(terms: DataFrame, dictionary: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """``(key, alias)``: each different ``key`` of ``terms`` with the entries that may reach the threshold."""
    if threshold < LEAST_THRESHOLD:
        raise ValueError(f"a threshold below {LEAST_THRESHOLD:g} cannot be met by common bigrams")
    known = dictionary.select("alias").where("alias <> ''").distinct()
    longest = known.agg(F.max(F.length("alias"))).first()[0] or 0
    near = F.length("key") * (threshold / (200.0 - threshold)) <= longest + 1e-9
    keys = terms.select("key").where("key <> ''").where(near).distinct()
    left = keys.select("key", F.posexplode(_known_by(F.col("key"), threshold)).alias("i", "gram")).withColumn("gram", F.col("gram.hash"))
    right = known.select("alias", F.posexplode(_known_by(F.col("alias"), threshold)).alias("j", "gram")).withColumn("gram", F.col("gram.hash"))
    n, m = F.length("key"), F.length("alias")
    lengths = F.least(n, m) * 200.0 / (n + m) >= threshold - 1e-9
    # the first bigram that a similar pair shares leaves room for all that it has in common
    room = F.least(n + 1 - F.col("i"), m + 1 - F.col("j")) >= F.ceil((n + m) * (3.0 * threshold / 200.0 - 1.0) + 1 - 1e-9)
    return left.join(right, "gram").where(lengths & room).select("key", "alias").distinct()


def similar(terms: DataFrame, dictionary: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """``(key, alias, ratio)`` of all pairs that reach the threshold; null and empty terms have none."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ratios = pa.array([ratio(k, a) for k, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ratios], names=["key", "alias", "ratio"])

    return candidates(terms, dictionary, threshold).mapInArrow(compared, "key string, alias string, ratio double").where(F.col("ratio") >= threshold)


def most_similar(terms: DataFrame, dictionary: DataFrame, threshold: float = vocab.FUZZY_THRESHOLD) -> DataFrame:
    """``(key, canonical)``: by the entry of ``dictionary (alias, canonical, ord)`` with the largest ratio, the first on ties."""
    pairs = similar(terms, dictionary, threshold).join(dictionary.select("alias", "canonical", "ord"), "alias")
    return pairs.groupBy("key").agg(F.max_by("canonical", F.struct(F.col("ratio"), -F.col("ord"))).alias("canonical"))
