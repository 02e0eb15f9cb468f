"""Resuming as a stream, and its estimate of the time left."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark.streaming.resume import answer_stream, progress, seconds_left

SCHEMA = "id string, raw string"


def _run(spark, tmp_path, calls):
    stream = spark.readStream.schema("id string, prompt string").json(str(tmp_path / "in"))

    def answer(rows):
        calls.extend(r.id for r in rows.collect())
        return rows.select("id", F.upper("prompt").alias("raw"))

    query = answer_stream(stream, answer, str(tmp_path / "out"), "id", SCHEMA, str(tmp_path / "state"))
    query.awaitTermination()


def _sink(spark, tmp_path):
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(str(tmp_path / "out")).where("id is not null")
    return sorted((r.id, r.raw) for r in rows.collect())


def _put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "prompt": p}) + "\n" for i, p in rows))


def test_each_key_is_answered_once(spark, tmp_path):
    calls = []
    _put(tmp_path, "a.json", [("1", "a"), ("2", "b"), ("2", "b"), (None, "x")])
    _run(spark, tmp_path, calls)
    assert _sink(spark, tmp_path) == [("1", "A"), ("2", "B")] and sorted(calls) == ["1", "2"]
    assert progress(spark, str(tmp_path / "out"), "id", SCHEMA, 10, 1, 5.0) == (2, 40.0)
    assert progress(spark, str(tmp_path / "none"), "id", SCHEMA, 10, 0, 5.0) == (0, None)
    _put(tmp_path, "b.json", [("2", "b"), ("3", "c")])
    _run(spark, tmp_path, calls)
    assert _sink(spark, tmp_path) == [("1", "A"), ("2", "B"), ("3", "C")] and sorted(calls) == ["1", "2", "3"]


def test_a_sink_with_a_torn_line_heals(spark, tmp_path):
    calls = []
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-0.json").write_text('{"id": "1", "raw": "old"}\n{"id": "2", "ra')
    _put(tmp_path, "a.json", [("1", "a"), ("2", "b")])
    _run(spark, tmp_path, calls)
    assert _sink(spark, tmp_path) == [("1", "old"), ("2", "B")] and calls == ["2"]


def test_seconds_left_counts_only_rows_of_this_run():
    assert seconds_left(10, 5, 55, 100) == pytest.approx(90)
    assert seconds_left(10, 0, 50, 100) is None
