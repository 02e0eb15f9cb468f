"""Values and lines beside others: trailing newlines, and planted personal data with what stands next to it."""

import re

import pytest

from sievemark.llm.pii import pseudonymise
from sievemark.llm.quality import quality_rules

LINES = ["abc\nabc\n", "abc\nabc\n\n", "abc\nabc", "abc\nabc\n\n\n", "\n", "\n\n", "", "abc", "abc\n", "\nabc\nabc\n", "a b\nabc\na b\n \n", "é\né\n", "abc\n abc\n", "x\nx\nx\n"]


def test_lines_of_texts_that_end_in_newlines(spark):
    # each text beside each other one, in both orders, as blocks hold texts without anything in between
    texts = [t for a in LINES for b in LINES for t in (a, b)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    got = {r.doc_id: r.n_dup_lines for r in quality_rules(rows).collect()}
    held = [[x for x in t.split("\n") if x.strip()] for t in texts]
    assert got == {i: len(x) - len(set(x)) for i, x in enumerate(held)}


CARDS = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"]
IBANS = ["BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00"]
BESIDE = [
    ("", " 12/27"), ("", " 123"), ("", "-123"), ("7 ", ""), ("1234 ", ""), ("7 ", " 12/27"), ("1234 5678 ", " 12 34"), ("", " 078-05-1120"), ("", " 2024-01-15"),
    ("2024-01-15 ", " 12"), ("", " 10.0.0.255"), ("", " EUR"), ("", " PAID"), ("AB12 ", ""), ("AB12 ", " EUR"), ("", " EUR 100"), ("", ""),
]


@pytest.fixture(scope="module")
def replaced(spark):
    planted = [(v, a, z) for v in CARDS for a, z in BESIDE if not re.search("[A-Z]", a + z)] + [(v, a, z) for v in IBANS for a, z in BESIDE if not re.match("[0-9-]", (a + z).strip() or "x")]
    rows = spark.createDataFrame([(i, f"see {a}{v}{z}, yes") for i, (v, a, z) in enumerate(planted)], "doc_id long, text string")
    out = {r.id: r.text for r in pseudonymise(rows, key="k").collect()}
    return [(v, a, z, out[i]) for i, (v, a, z) in enumerate(planted)]


def test_planted_numbers_do_not_stay_beside_others(replaced):
    plain = lambda x: re.sub("[ -]", "", x)
    assert not [(v, a, z, new) for v, a, z, new in replaced if plain(v) in plain(new)]
    for value in ("078-05-1120", "2024-01-15", "10.0.0.255"):
        assert all(value not in new for _, a, z, new in replaced if value in a + z)
    assert all(new.endswith(z + ", yes") for _, a, z, new in replaced if z in (" EUR", " PAID", " 12/27", " EUR 100"))


def test_dates_of_timestamps(spark):
    texts = ["at 2024-01-15T10:00 on", "2024-01-15T10:00:00Z", "2024-01-15T1000", "2024-01-15"]
    got = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("id").collect()]
    new = got[3]
    assert new != texts[3] and got == [t.replace("2024-01-15", new) for t in texts]


def test_runs_of_digits_that_hold_no_card(spark):
    texts = ["1" * 40, "1 2 3 4 5 6 7", "4111 1111 1111 1112", " ".join(["4111 1111 1111 1111"] * 30), "1 " * 3000]
    got = [r.text for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("id").collect()]
    assert got[:3] == texts[:3] and "4111 1111 1111 1111" not in got[3] and len(set(re.findall("[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}", got[3]))) == 1
    assert len(got[4]) == 6000
