"""Schedules of the mixing operator."""

from collections import Counter

import pytest

from sievemark.llm.mixing import mix, pfair_slots, quotas


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.1}, {str(i): i + 1 for i in range(20)}])
def test_deviation_is_less_than_one_block(weights):
    quota = quotas(weights, 256)
    assert sum(quota.values()) == 256
    slots = pfair_slots(quota)
    at = {t: s for s, ts in slots.items() for t in ts}
    assert sorted(at) == list(range(256))
    had: Counter = Counter()
    for t in range(256):
        had[at[t]] += 1
        assert all(abs(had[s] - (t + 1) * q / 256) < 1 for s, q in quota.items())


def test_repeat_keeps_the_shares(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3000 else "b") for i in range(3300)] + [(None, None)] * 5, "doc_id long, source string")
    got = mix(rows, {"a": 0.5, "b": 0.4}, block=10, period=10, repeat=True).collect()
    assert {r.row.doc_id for r in got} == {i for i in range(3300)} | {None}
    share = Counter(r.source for r in got)
    assert abs(share["a"] / len(got) - 0.5) < 0.01 and abs(share["b"] / len(got) - 0.4) < 0.01
    assert len({(r.slot, r.place) for r in got}) == len(got)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
