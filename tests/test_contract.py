"""The contract: JSON Schema, Spark type and validating column admit the same, and name what they refuse."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark.functions import contract, vocab
from sievemark.operators import agreement, parsing, training

GOOD = {"title": "t", "seniority": ["mid"], "work_mode": [], "tech_expected": ["a"], "tech_optional": [], "contract_types": ["b2b"], "salary": {"kind": "b2b", "currency": "PLN", "amount_from": 1.0, "amount_to": None, "period": None}}
BAD = {
    "seniority": [["guru"], [None], ["mid", "Mid"]], "work_mode": [["beach"], [""]], "tech_expected": [[None], ["a", None]], "tech_optional": [[None]], "contract_types": [["x", None]],
    "salary": [{"kind": "b2c"}, {"kind": ""}],
}


def admits(schema, value, root=None):
    """Enough of JSON Schema to read what the compiler writes."""
    root = root or schema
    if "$ref" in schema:
        return admits(root["$defs"][schema["$ref"].rpartition("/")[2]], value, root)
    if "anyOf" in schema:
        return any(admits(s, value, root) for s in schema["anyOf"])
    if "enum" in schema:
        return value in schema["enum"]
    kind = schema["type"]
    if kind == "object":
        return isinstance(value, dict) and (schema["additionalProperties"] or set(value) <= set(schema["properties"])) and all(admits(schema["properties"][k], v, root) for k, v in value.items())
    if kind == "array":
        return isinstance(value, list) and all(admits(schema["items"], v, root) for v in value)
    return {"string": isinstance(value, str), "number": isinstance(value, int | float) and not isinstance(value, bool), "null": value is None}[kind]


def cases():
    yield GOOD, None
    for field, values in BAD.items():
        for value in values:
            yield {**GOOD, field: value}, "salary.kind" if field == "salary" else field
    yield {**GOOD, "salary": None}, None
    yield {**GOOD, "title": None, "tech_expected": []}, None


def test_types_of_the_contract():
    assert contract.spark_type(contract.POSTING) == vocab.POSTING and contract.spark_type(contract.GOLD) == vocab.GOLD and contract.spark_type(contract.SALARY) == vocab.SALARY


def test_schema_and_column_agree(spark):
    schema = json.loads(contract.schema_text())
    assert schema["additionalProperties"] is False and set(schema["$defs"]) == {"Seniority", "WorkMode", "SalaryKind", "Salary"}
    assert not admits(schema, {"colour": 1}) and not admits(schema, {"title": 3}) and admits(schema, {})
    rows = [(i, json.dumps(g)) for i, (g, _) in enumerate(cases())]
    frame = spark.createDataFrame(rows, "i long, g string").select("i", F.from_json("g", vocab.GOLD).alias("gold"))
    found = {r.i: list(r.v) for r in frame.select("i", contract.violations(F.col("gold"), contract.GOLD).alias("v")).collect()}
    for i, (gold, broken) in enumerate(cases()):
        assert found[i] == ([broken] if broken else []) and admits(schema, gold) == (not broken)


def test_parser_and_schema_agree():
    """What the parser has made of an answer fits the schema, whatever the answer was."""
    schema = contract.json_schema(contract.POSTING)
    for gold, _ in cases():
        made, failure = parsing.parse_one(json.dumps(gold), {})
        assert (failure == "schema_invalid" and gold["salary"]["kind"] in ("b2c", "")) or gold["contract_types"] != ["b2b"] or admits(schema, made)


def test_labels_are_refused_by_name(spark):
    for i, (gold, broken) in enumerate(cases()):
        one = spark.createDataFrame([(i, json.dumps(gold))], "offer_id long, g string").select("offer_id", F.lit("p").alias("prose"), F.from_json("g", vocab.GOLD).alias("gold"))
        nested = one.select("offer_id", F.col("gold").alias("human_gold"))
        flat = one.select("offer_id", F.lit(None).cast(vocab.GOLD).alias("human_gold"), "gold.*")
        bare = one.select("offer_id", "gold.seniority", "gold.work_mode", "gold.salary")
        checks = [(training.sft_examples(one, "s", "i", "ok"), f"gold of {i} does not fit the schema: {broken}"), *((agreement.checked_human_gold(x), f"human_gold row {i} does not fit the schema: {broken}") for x in (nested, flat))]
        if broken in ("seniority", "work_mode", "salary.kind"):
            checks.append((agreement.checked_human_gold(bare), f"human_gold row {i}"))
        for frame, message in checks:
            if broken:
                with pytest.raises(Exception, match=message):
                    frame.collect()
            else:
                assert frame.count() == 1


def test_labels_to_come_are_left_alone(spark):
    rows = spark.createDataFrame([(1, None), (None, None)], f"offer_id long, human_gold {vocab.GOLD}")
    assert agreement.checked_human_gold(rows).count() == 2


def test_ids_are_handed_on_a_few_rows_at_a_time(spark, monkeypatch):
    """Batches of one Arrow batch from Spark: none holds more than a bound of ids and one row, and no row is lost."""
    made = []

    def watched(frame, run, kind, real=type(spark.range(0)).mapInArrow):
        made.append(run)
        return real(frame, run, kind)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", watched)
    monkeypatch.setattr(training, "MOST_IDS", 1000)
    template = lambda: lambda asked, answer: [7] * sum(len(m["content"]) for m in asked)
    rows = [(i if i % 9 else None, [{"role": "user", "content": "x" * (i % 300)}] if i % 7 else None, "ok") for i in range(3000)]
    frame = spark.createDataFrame(rows, "offer_id long, prompt_messages array<struct<role:string,content:string>>, completion string")
    got = training.encoded(frame, template, 10**9)
    assert sorted(tuple(r) for r in got.selectExpr("coalesce(offer_id, -1)", "coalesce(size(input_ids), -1)").collect()) == sorted((-1 if i is None else i, -1 if m is None else len(m[0]["content"]) + 2) for i, m, _ in rows)
    parts = list(made[0](iter([frame.toArrow().combine_chunks().to_batches()[0]])))
    assert sum(p.num_rows for p in parts) == 3000 and max(p.num_rows for p in parts) <= 1000
    assert max(len(p.column(1).flatten()) for p in parts) < 1000 + 302
