"""Runs of a model, labels of an arbiter, stored runs, and the full report of agreement."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark.functions import vocab
from sievemark.operators import agreement, runs
from sievemark.plans.queries import _gold


def test_a_run_has_tokens_cap_and_parsed_answer(spark):
    def answerer():
        return lambda text: {"a": ('{"title": "A"}', 4, 2), "b": ("no", None, 1), "": (None, 0, None)}[text]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "offer_id long, prompt string")
    got = {r.offer_id: r for r in runs.run(rows, answerer, None).collect()}
    assert [(got[i].valid, got[i].failure, got[i].input_tokens, got[i].output_tokens, got[i].max_tokens) for i in (1, 2, 3)] == [
        (True, None, 4, 2, None), (False, "no_json_object", None, 1, None), (False, "empty_output", 0, None, None),
    ]
    assert got[1].parsed.title == "A" and got[1].latency_s >= 0
    labels = {r.offer_id: (r.arbiter_gold and r.arbiter_gold.title, r.arbiter_valid) for r in runs.arbiter_labels(rows, answerer).collect()}
    assert labels == {1: ("A", True), 2: (None, False), 3: (None, False)}
    assert runs.run(rows.where("false"), answerer, 5).collect() == []


def test_shots_by_mode(spark):
    rows = spark.createDataFrame([("few", [1, 2, 3]), ("zero", [1, 2, 3]), ("few", []), (None, [1])], "mode string, shots array<int>")
    assert [r[0] for r in rows.select(runs.shots_for(F.col("mode"), F.col("shots"), 2)).collect()] == [[1, 2], [], [], []]


def test_stored_runs_are_scored_again(spark, tmp_path):
    gold = spark.createDataFrame([(1,), (2,)], "offer_id long").withColumn("gold", _gold(title=F.lit("x"), seniority=F.array(F.lit("mid"))))
    schema = f"offer_id long, valid boolean, parsed {vocab.POSTING}, input_tokens long, output_tokens long, latency_s double"
    with pytest.raises(FileNotFoundError):
        runs.rescored(spark, str(tmp_path / "none"), gold, schema)
    row = lambda i: json.dumps({"offer_id": i, "valid": True, "parsed": {"title": "x", "seniority": ["mid"]}, "input_tokens": 1, "output_tokens": 1, "latency_s": 1.0})
    (tmp_path / "a.jsonl").write_text(row(1) + "\n" + row(2) + "\n")
    (tmp_path / "b.jsonl").write_text(row(1) + "\n")
    got = {r.variant: (r.n, r.coverage, r.headline_f1) for r in runs.rescored(spark, str(tmp_path), gold, schema).collect()}
    assert got == {"a": (2, 1.0, 1.0), "b": (1, 0.5, 1.0)}


def test_full_report_has_labels_by_hand_only_where_there_are_some(spark):
    ids = spark.createDataFrame([(1,), (2,)], "offer_id long")
    leg = lambda level: ids.select("offer_id", _gold(title=F.lit("t"), seniority=F.array(level)).alias("label"))
    mid, odd = F.lit("mid"), F.when(F.col("offer_id") == 1, "mid").otherwise("lead")
    two = agreement.full_report(leg(mid), leg(odd))
    assert {r.pair for r in two.select("pair").distinct().collect()} == {"llm_platform"}
    got = {(r.pair, r.field, r.metric): r.value for r in agreement.full_report(leg(mid), leg(odd), leg(odd)).collect()}
    assert got["llm_platform", "seniority", "agreement"] == got["llm_human", "seniority", "agreement"] == 0.5
    assert got["platform_human", "seniority", "agreement"] == 1.0
    assert got["triangulation", "seniority", "llm_error"] == 1 and got["triangulation", "seniority", "all_agree"] == 1
