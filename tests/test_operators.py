"""Operators beside plain Python, on cases where order, repeats and bad values matter."""

import random

import pytest
from pyspark.sql import functions as F

from sievemark.operators import agreement, curate, parsing, scoring, training
from sievemark.sources import records


def test_dedupe_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, *range(60)]), rng.choice("abcdefghijklmnopqrstuvwxyz")) for i in range(150)]
    seen_a, seen_b, want = set(), set(), []
    for pos, a, b in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            want.append(pos)
    got = curate.dedupe(spark.createDataFrame(rows, "pos long, a long, b string"), ("a", "b"))
    assert sorted(r.pos for r in got.collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_splits_against_a_sort(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "2024-01-01", "2024-01-02", "2024-02-01"])) for i in range(n)]
    frame = spark.createDataFrame(rows, "pos long, pub_date string")
    k = min(max(1, round(n * 0.3)), n - 1) if n >= 2 else 0
    late = sorted(rows, key=lambda r: (r[1] or "", r[0]), reverse=True)[:k]
    assert {r.pos for r in curate.dev_split(frame, 0.3).where("split = 'dev'").collect()} == {r[0] for r in late}


def test_parser_leaves_bad_rows_bad():
    salary = lambda s: '{"salary": %s}' % s
    for text, currency in (('{"currency": ["PLN"]}', None), ('{"currency": 5}', None), ('{"currency": ""}', None), ('{"currency": " zł "}', "PLN")):
        parsed, failure = parsing.parse_one(salary(text), {})
        assert failure is None and parsed["salary"]["currency"] == currency
    assert parsing.parse_one(salary('{"amount_from": 1%s}' % ("0" * 400)), {})[1] == "schema_invalid"
    assert parsing.parse_one(salary('{"amount_from": 1%s}' % ("0" * 5000)), {})[1] == "json_decode_error"
    assert parsing.parse_one("[" * 5 + '{"a":' * 100_000, {})[1] == "json_decode_error"


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(0, 1, "a"), (1, 1, "b"), (2, 2, "c")], "pos long, offer_id long, title string")
    legs = rows.select("pos", "offer_id", F.struct("title").alias("label"))
    assert {(r.offer_id, r.a.title, r.b.title) for r in agreement.pairs(legs, legs).collect()} == {(1, "b", "b"), (2, "c", "c")}
    with pytest.raises(Exception, match="repeated key"):
        agreement.pairs(legs.drop("pos"), legs).collect()


def test_sinks(spark, tmp_path):
    path, schema = str(tmp_path / "sink"), "id long, x string"
    assert records.read_optional(spark, path, schema) is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    records.append_missing(rows, path, "id", schema)
    (tmp_path / "sink" / "part-torn.json").write_text('{"id":3,"x":"c"}\n{"id":4,"x":"d')
    records.append_missing(rows.unionByName(spark.createDataFrame([(3, "c"), (4, "d")], schema)), path, "id", schema)
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id()).withColumnRenamed("value", "line")
    done = records.load_completed(lines, "id", schema, ("x",))
    assert {(r.id, r.x) for r in done.collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d")}
    assert records.backup_once(spark, path, ".old") and not records.backup_once(spark, path, ".old")
    assert spark.read.text(path + ".old").count() == spark.read.text(path).count()
    held = rows.withColumns({"pos": F.col("id"), "max_tokens": F.lit(512), "keys": F.array(F.lit("x"))})
    assert not records.backup_superseded(path, held, held, ("x",))
    assert records.backup_superseded(path, held.limit(1), held, ("x",)) and spark.read.text(path + ".cap512").count()


def test_guards(spark):
    rows = spark.range(5)
    with pytest.raises(ValueError):
        records.head_limit(rows, -1, "id")
    with pytest.raises(ValueError):
        records.hard_cap(rows, 4)
    assert records.head_limit(rows, 0, "id").count() == records.hard_cap(rows, 5).count() == 5
    assert [r.id for r in records.typed(spark.createDataFrame([("1", 2)], "b string, id int"), "id long, b string").collect()] == [2]
    with pytest.raises(TypeError):
        records.typed(rows, "id long, b string")
    assert records.markdown(rows.limit(2).withColumn("x", F.lit(0.12345)), "id") == "| id | x |\n| - | - |\n| 0 | 0.1235 |\n| 1 | 0.1235 |"
    with pytest.raises(ValueError):
        training.longest_prompt(rows, F.col("id") * 100, 450, 50, 1)
    assert training.longest_prompt(rows.where("false"), F.col("id"), 1, 0) == 0
    bad = spark.createDataFrame([(7, (["guru"], [], (None,)))], "offer_id long, human_gold struct<seniority:array<string>,work_mode:array<string>,salary:struct<kind:string>>")
    with pytest.raises(Exception, match="human_gold row 7"):
        agreement.checked_human_gold(bad).collect()


def test_encoding_shrinks_the_posting(spark):
    asked = lambda prose: [("system", "be brief"), ("user", prose)]
    prose = " ".join(f"w{i}" for i in range(200))
    rows = spark.createDataFrame(
        [(1, asked(prose), "one two"), (2, asked("short"), "one"), (3, asked(""), "x " * 60), (4, None, "x"), (5, asked("y"), None)],
        "offer_id long, prompt_messages array<struct<role:string,content:string>>, completion string",
    )
    template = lambda messages, answer: [x for m in messages for x in (7, *(len(w) for w in m["content"].split()))] + [7] * answer
    got = {r.offer_id: r for r in training.encoded(rows, lambda: template, 50).collect()}
    kept = prose
    while len(template([{"content": "be brief"}, {"content": kept}, {"content": "one two"}], False)) > 50:
        kept = kept[: len(kept) - max(1, len(kept) // 10)]
    prompt = template([{"content": "be brief"}, {"content": kept}], True)
    assert got[1].input_ids == [*prompt, 3, 3] and got[1].labels == [-100] * len(prompt) + [3, 3] and got[1].cut_chars == len(prose) - len(kept)
    assert (got[1].attention_mask, got[1].prompt_length) == ([1] * len(got[1].input_ids), len(prompt))
    assert (got[2].input_ids, got[2].labels, got[2].cut_chars) == ([7, 2, 5, 7, 5, 7, 3], [-100] * 6 + [3], 0)
    assert len(got[3].input_ids) == 65 and got[3].labels[-60:] == [1] * 60  # too long even without a posting: returned whole
    assert got[4].input_ids is None and got[5].labels is None


def test_each_cut_asks_the_template_for_the_whole_alone(spark):
    """The prompt is asked for once a row, and the cut is the first that fits, also where less text has more ids."""

    def ids(messages, answer):
        return [x for m in messages for x in (7, *([9] * (60 if len(m["content"]) % 7 == 3 else len(m["content"]))))] + [7] * answer

    def first_fit(messages, completion, most):
        *before, last = messages
        kept, answer = last["content"], {"role": "assistant", "content": completion}
        while True:
            asked = [*before, {**last, "content": kept}]
            prompt, whole = ids(asked, True), ids([*asked, answer], False)
            if len(whole) <= most or not kept:
                return whole, [-100] * len(prompt) + whole[len(prompt) :], len(last["content"]) - len(kept)
            kept = kept[: len(kept) - max(1, len(kept) // 10)]

    asked = []

    def template(messages, answer):
        asked.append(answer)
        return ids(messages, answer)

    rows = [([{"role": "system", "content": "s"}, {"role": "user", "content": "x" * n}], "c" * c) for n in (0, 1, 10, 31, 200, 999) for c in (0, 2, 90)]
    for most in (0, 30, 70, 10**6):
        for messages, completion in rows:
            asked.clear()
            assert training.encode_one(messages, completion, template, most) == first_fit(messages, completion, most)
            assert asked.count(True) == 1
    frame = [(1, *rows[13]), (1, *rows[13]), (None, *rows[7]), (2, None, "x"), (3, [], "x"), (4, rows[4][0], None)]  # ids come twice, or are null
    frame = spark.createDataFrame(frame, "offer_id long, prompt_messages array<struct<role:string,content:string>>, completion string")
    got = [(r.offer_id, r.input_ids, r.labels, r.cut_chars) for r in training.encoded(frame, lambda: ids, 70).collect()]
    made = [(i, *first_fit(*rows[k], 70)) for i, k in ((1, 13), (1, 13), (None, 7))] + [(i, None, None, None) for i in (2, 3, 4)]
    assert sorted(got, key=repr) == sorted(made, key=repr)


def test_a_template_that_breaks_the_prompt(spark):
    rows = spark.createDataFrame([(1, [("user", "a")], "b")], "offer_id long, prompt_messages array<struct<role:string,content:string>>, completion string")
    with pytest.raises(Exception, match="does not begin the whole with the prompt"):
        training.encoded(rows, lambda: lambda messages, answer: [len(messages)], 50).collect()


def test_report_rows_of_variants_without_gold(spark):
    kind = "struct<title:string,seniority:array<string>,work_mode:array<string>,tech_expected:array<string>,tech_optional:array<string>,salary:struct<kind:string,currency:string,amount_from:double,amount_to:double,period:string>>"
    label = ("t", ["mid"], [], [], [], None)
    preds = spark.createDataFrame([("a", 1, True, label, 1, 1, 1.0), ("z", 9, True, label, 1, 1, 1.0)], f"variant string, offer_id long, valid boolean, parsed {kind}, input_tokens long, output_tokens long, latency_s double")
    gold = spark.createDataFrame([(1, label)], f"offer_id long, gold {kind}")
    got = {r.variant: r for r in scoring.report(preds, gold).collect()}
    assert (got["z"].n, got["z"].n_gold, got["z"].coverage, got["z"].json_validity) == (0, 1, 0.0, 0.0) and got["a"].headline_f1 == 1.0
