"""Terms in texts by one automaton, against a regular expression for each term."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievemark.operators import ceiling
from sievemark.operators.ceiling import Spellings, folded
from sievemark.sources import records

NAMES = {"react": ["reactjs", "react.js"], "react native": None, "c++": ["cpp"], "c": None, "node": ["node.js", "NodeJS"], ".net": ["dotnet"], "żółw": ["zolw"], "σίσυφος": None, "straße": None, "a_b": ["a-b"]}


def by_regex(pairs, term, text):
    names = {a for a, c in pairs if c == term} | ({term} if any(c == term for _, c in pairs) else set()) or {term}
    return any(re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.IGNORECASE) for n in names)


@pytest.fixture(scope="module")
def pairs(spark):
    return [(r.alias, r.canonical) for r in records.aliases(spark, NAMES).collect()]


def test_against_regular_expressions(pairs):
    known, r = Spellings(pairs), random.Random(7)
    parts = ["React", "reactJS", "react", "native", "C++", "c", "+", "node.js", "NODE", ".", ".NET", "x", "ŻÓŁW", "żółw", "ΣΊΣΥΦΟΣ", "straße", "STRASSE", "a_b", "A-B", "_", "1", "é", "İ", "K", "s"]
    terms = [*NAMES, "go", "x", "R", "+", "unknown term", "İ", "é"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", ",", "\n"]) for _ in range(r.randrange(8)))
        low = folded(text)
        assert len(low) == len(text)
        found = known.found(low)
        for term in terms:
            assert known.present(low, found, term) == by_regex(pairs, term, text), (text, term)


def test_records(spark):
    gold = lambda *xs: {"tech_expected": list(xs), "tech_optional": None}
    rows = [(1, "We use ReactJS and C++.", gold("react", "c++", "c", "cobol")), (1, "COBOL only", gold("cobol", "cobol", "react")), (2, None, gold("react")), (3, "react", gold()), (4, "nothing", None)]
    frame = spark.createDataFrame(rows, "offer_id long, prose string, gold struct<tech_expected:array<string>,tech_optional:array<string>>")
    got = {r.field: tuple(r)[1:] for r in ceiling.ceilings(frame, records.aliases(spark, NAMES)).collect()}
    assert got == {"tech_expected": (8, 5, 3, 1, 0.625, 0.3333), "tech_optional": (0, 0, 0, 0, None, None)}
    assert {r.field: r.terms for r in ceiling.ceilings(frame.limit(0), records.aliases(spark, {})).collect()} == {"tech_expected": 0, "tech_optional": 0}


def test_found_terms(spark):
    frame = spark.createDataFrame([(1, "node, React Native"), (2, None), (3, "")], "found long, prose string")
    got = {r.found: r.terms for r in ceiling.found_terms(frame, records.aliases(spark, NAMES), into="terms").collect()}
    assert got == {1: ["node", "react", "react native"], 2: [], 3: []}


def test_a_dictionary_that_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(ceiling, "MOST_SPELLINGS", 3)
    with pytest.raises(ValueError, match="more than 3 spellings"):
        ceiling.spellings(records.aliases(spark, NAMES))


def test_a_thousand_spellings_take_about_the_time_of_five():
    text, r = " ".join(f"w{i % 977}" for i in range(300_000)), random.Random(2)
    few, many = [(f"v{i}", f"v{i}") for i in range(5)], [(f"v{r.randrange(10**9)}", f"t{i}") for i in range(1000)]

    def took(pairs):
        known, best = Spellings(pairs), 9e9
        for _ in range(5):
            began = time.process_time()
            known.found(text)
            best = min(best, time.process_time() - began)
        return best

    assert took(many) < 3 * took(few) + 0.05


def test_one_pass_over_the_records(spark):
    frame = spark.range(10).select(F.col("id").alias("offer_id"), F.lit("react").alias("prose"), F.struct(F.array(F.lit("react")).alias("tech_expected"), F.array(F.lit("c")).alias("tech_optional")).alias("gold"))
    plan = ceiling.ceilings(frame, records.aliases(spark, NAMES))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Range") == 1


def test_batches_of_long_texts_are_read_in_pieces(spark, monkeypatch):
    """What a task makes of one Arrow batch comes in pieces of about a MB of text, with the sums of the whole."""
    made = []

    def watched(frame, run, kind, real=type(spark.range(0)).mapInArrow):
        made.append(run)
        return real(frame, run, kind)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    gold = F.struct(F.array(F.lit("react"), F.lit("cobol")).alias("tech_expected"), F.array().cast("array<string>").alias("tech_optional"))
    frame = spark.range(200).select(F.col("id").alias("offer_id"), F.concat(F.repeat(F.lit("x"), 50_000), F.lit(" ReactJS")).alias("prose"), gold.alias("gold"))
    got = {r.field: (r.terms, r.present, r.records) for r in ceiling.ceilings(frame, records.aliases(spark, NAMES)).collect()}
    assert got == {"tech_expected": (400, 200, 200), "tech_optional": (0, 0, 0)}
    found = ceiling.found_terms(frame.select("offer_id", "prose"), records.aliases(spark, NAMES))
    assert found.where("found = array('react')").count() == 200
    batch = frame.select("prose", "gold.tech_expected", "gold.tech_optional").toArrow().combine_chunks().to_batches()[0]
    parts = [p.num_rows for p in made[0](iter([batch]))]
    assert sum(parts) == 200 and max(parts) < 25
