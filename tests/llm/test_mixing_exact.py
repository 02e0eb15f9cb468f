"""The mix keeps exact weights over many sources and long lines."""

from collections import Counter
from fractions import Fraction

from sievemark.llm.mixing import mix, schedule


def deviation(weights, slots):
    """Largest distance of a source from its exact share, before and after each of its blocks."""
    total = sum(map(Fraction, weights.values()))
    shares = {s: Fraction(w) / total for s, w in weights.items()}
    return max(max(abs(k - shares[s] * t), abs(k + 1 - shares[s] * (t + 1))) for s, own in slots.items() for k, t in enumerate(own))


def test_long_lines_do_not_drift():
    weights = {"a": 0.70013, "b": 0.2, "c": 0.0991, "d": 0.00077}
    slots = schedule(weights, {"a": 21_000, "b": 1, "c": 1, "d": 1}, on=True)
    assert sum(map(len, slots.values())) > 29_000 and sorted(t for own in slots.values() for t in own) == list(range(max(map(max, slots.values())) + 1))
    assert deviation(weights, slots) < 1
    assert deviation(weights, schedule(weights, {"a": 5, "b": 3000, "c": 10, "d": 20})) < 1


def test_tiny_sources_are_not_inflated():
    n = {"hot": 2_000_000} | {f"s{i}": 1 for i in range(300)}
    weights = {s: x**0.7 for s, x in n.items()}
    slots = schedule(weights, {s: -(-x // 64) for s, x in n.items()}, on=True)
    line = 1 + max(map(max, slots.values()))
    assert all(abs(len(own) - line * weights[s] / sum(weights.values())) < 1 for s, own in slots.items())


def test_more_sources_than_a_thousand(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'hot' WHEN id = 8999 THEN NULL ELSE concat('site', id % 1500) END AS source")
    for repeat in (False, True):
        got = mix(rows, block=4, repeat=repeat).collect()
        assert Counter(r.row.doc_id for r in got if r.epoch == 0) == Counter(range(9000))
        assert len({(r.slot, r.place) for r in got}) == len(got) and len({r.source for r in got}) == 1502


def test_the_query_against_a_plain_walk_over_the_slots(spark, sf):
    """At each slot the released block with the earliest deadline, all sources looked at one by one."""
    import math

    from sievemark.llm import queries

    n = Counter(r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").collect())
    weights = {s: Fraction(x**0.7 / sum(y**0.7 for y in n.values())) for s, x in n.items()}
    total = sum(weights.values())
    share, blocks = {s: w / total for s, w in weights.items()}, {s: -(-x // 64) for s, x in n.items()}
    had, want, t = Counter(), {}, 0
    while had != blocks:
        waiting = [s for s in blocks if had[s] < blocks[s] and math.floor(had[s] / share[s]) <= t]
        if waiting:
            first = min(waiting, key=lambda s: (math.ceil((had[s] + 1) / share[s]), s is not None, str(s)))
            want[first, had[first]] = t
            had[first] += 1
        t += 1
    got = queries.op3_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert {(r.source, r.block): r.slot for r in got} == want
    filled = Counter((r.source, r.block) for r in got)
    assert all(filled[s, k] == min(64, n[s] - 64 * k) for s, k in filled)
    assert all({r.place for r in got if (r.source, r.block) == b} == set(range(c)) for b, c in filled.items())
