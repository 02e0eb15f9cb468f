"""The similarity join against all pairs, with a plain table of common subsequences."""

import random

import pytest

from sievemark.operators import curate
from sievemark.operators.similar import bigrams, candidates, ratio, similar
from sievemark.sources import records


def plain_ratio(a, b):
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for c in a:
        done = [0]
        for j, d in enumerate(b):
            done.append(row[j] + 1 if c == d else max(row[j + 1], done[j]))
        row = done
    return 200.0 * row[-1] / (len(a) + len(b))


def misspelt(r, word):
    for _ in range(r.randrange(4)):
        i = r.randrange(len(word) + 1)
        word = r.choice([word[:i] + r.choice("abcé") + word[i:], word[:i] + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]])
    return word


def test_ratio():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(r.choices("abé", k=r.randrange(9))) for _ in range(2))
        assert ratio(a, b) == plain_ratio(a, b)


@pytest.mark.parametrize("threshold", [70.0, 80.0, 88.0, 100.0])
def test_no_pair_is_lost(spark, threshold):
    r = random.Random(int(threshold))
    names = ["".join(r.choices("abcd", k=r.randrange(1, 14))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "é" * 6, "a"]
    keys = [misspelt(r, r.choice(names)) for _ in range(300)] + ["", None, "aaaaaaaaaa", "x" * 5000]
    terms = spark.createDataFrame([(k,) for k in keys], "key string")
    dictionary = spark.createDataFrame([(n,) for n in names], "alias string")
    got = {(p.key, p.alias): p.ratio for p in similar(terms, dictionary, threshold).collect()}
    want = {(k, n): x for k in {*keys} - {"", None} for n in {*names} if (x := plain_ratio(k, n)) >= threshold}
    assert got == want and len(want) > 30


def test_bigrams_are_a_set(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("aaaa",)], "t string").select(bigrams(F.col("t")).alias("g")).first()
    assert len(set(row.g)) == 5


def test_few_candidates(spark):
    r = random.Random(3)
    words = [("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10)),) for _ in range(2000)]
    found = candidates(spark.createDataFrame(words, "key string"), spark.createDataFrame(words, "alias string"))
    assert found.count() < 2000 * 2000 / 20
    with pytest.raises(ValueError):
        candidates(spark.createDataFrame(words, "key string"), spark.createDataFrame(words, "alias string"), 50)


def test_the_first_of_equally_similar_names(spark):
    names = records.aliases(spark, {"abcdefghij": ["second"], "abcdefghik": None, "zzz": ["abcdefghil"]})
    terms = spark.createDataFrame([("abcdefghi",), (" ABCDEFGHI ",), ("second",), ("seconds",), ("none",), ("",), (None,)], "term string")
    got = {r.term: r.canonical for r in curate.normalise_terms(terms, names).collect()}
    assert got == {"abcdefghi": "abcdefghij", " ABCDEFGHI ": "abcdefghij", "second": "abcdefghij", "seconds": "abcdefghij", "none": "none", "": "", None: ""}


def test_lists_of_rows_that_share_an_id(spark):
    rows = spark.createDataFrame([(1, ["JS", "x"], 1), (1, ["js", "JS", " "], 2), (None, ["Typescripts"], 3), (2, None, 4), (3, [None, "y"], 5)], "offer_id long, t array<string>, n int")
    names = records.aliases(spark, {"javascript": ["js"], "typescript": None})
    got = {r.n: r.t for r in curate.normalise_lists(rows, ("t",), names).collect()}
    assert got == {1: ["javascript", "x"], 2: ["javascript"], 3: ["typescript"], 4: [], 5: ["y"]}
    assert {r.n: r.t for r in curate.normalise_lists(rows, ("t",), names, distinct=False).collect()}[2] == ["javascript", "javascript"]
    assert curate.normalise_lists(rows.limit(0), ("t",), names).count() == 0


@pytest.mark.parametrize("most", [100, 0])
def test_terms_of_all_rows_are_not_broadcast(spark, monkeypatch, most):
    """Rows so alike that their file is small; no side of a join that has a row's number is a broadcast."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(curate, "BROADCAST_TERMS", most)
    rows = spark.range(20000).select(F.col("id").alias("offer_id"), F.array(F.lit("js"), F.lit("Typescripts"), F.lit("x")).alias("t"), F.repeat(F.lit("y"), 500).alias("wide"))
    made = curate.normalise_lists(rows, ("t",), records.aliases(spark, {"javascript": ["js"], "typescript": None}))
    assert {(tuple(r.t), r["count"]) for r in made.groupBy("t").count().collect()} == {(("javascript", "typescript", "x"), 20000)}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 - bool(most) and "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == bool(most)


def test_terms_are_found_once_and_only_renamed_ones_are_joined(spark, monkeypatch):
    """The terms are worked out once for the comparison and the result; names that are the term itself are not dealt to rows."""
    written, real = {}, curate.materialise
    monkeypatch.setattr(curate, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    names = records.aliases(spark, {"javascript": ["js"], "typescript": None})
    lists = [None, [], [None], ["", " ", None], ["javascript", "JS", "x"], [" X ", "x", "Typescripts", "typescript"], ["cobol"], ["js"], ["javascrip"] * 2]
    terms = spark.createDataFrame([(t,) for k in lists for t in k or ()], "term string")
    got = {r.term: r.canonical for r in curate.normalise_terms(terms.mapInArrow(run, terms.schema), names).collect()}
    assert seen.value == terms.count()
    want = {"javascript": "javascript", "JS": "javascript", "js": "javascript", "javascrip": "javascript", "Typescripts": "typescript", "typescript": "typescript", "x": "x", " X ": "x", "cobol": "cobol", "": "", " ": "", None: ""}
    assert got == want

    rows = [(n % 4 or None, k, lists[-n], n) for n, k in enumerate(lists)]  # ids come twice, or are null
    rows = spark.createDataFrame(rows, "offer_id long, a array<string>, b array<string>, n int")
    for distinct in (True, False):
        written.clear()
        made = {r.n: (r.offer_id, r.a, r.b) for r in curate.normalise_lists(rows, ("a", "b"), names, distinct=distinct).collect()}
        for n, k in enumerate(lists):
            both = [[v for t in x or () if t is not None and (v := want[t])] for x in (k, lists[-n])]
            assert made[n] == (n % 4 or None, *(list(dict.fromkeys(x)) if distinct else x for x in both))
        assert {(r.term, r.canonical) for r in written["term-names"].collect()} == {(t, c) for t, c in want.items() if t is not None and t != c}
