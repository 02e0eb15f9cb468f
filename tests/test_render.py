"""Reports as Markdown and JSON: dashes for what cannot be measured, only classes that occur, replaced as a whole."""

import json

import pytest

from sievemark.operators import render


def test_cells():
    assert [render.shown(x) for x in (None, 0.125, 3, "a|b\nc", True)] == ["-", "0.12", "3", "a\\|b c", "True"]


def test_variants_and_failures(spark):
    kind = "variant string, coverage double, trustworthy boolean, json_validity double, detection double, currency double, kind double, amounts double, headline_f1 double, cost_per_1k double, latency_p50 double, latency_p95 double"
    report = spark.createDataFrame([("b", 0.5, False, 0.8, 0.6, None, 0.0, 1.0, 0.3, None, 1.0, 2.0), ("a", 1.0, True, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 4.4723, 0.5, None)], kind)
    scores = spark.createDataFrame([("a", "seniority", 0.5), ("a", "work_mode", None), ("b", "tech_expected", 0.25)], "variant string, field string, f1 double")
    lines = render.variants(report, scores).split("\n")
    assert lines[2] == "| a | 1.00 | 1.00 | 0.50 | - | - | 1.00 | 1.00/1.00/1.00 | 1.00 | 4.47 | 0.50 | - |"
    assert lines[3] == "| b | 0.50 (!) | 0.80 | - | - | 0.25 | 0.60 | -/0.00/1.00 | 0.30 | - | 1.00 | 2.00 |"
    counts = spark.createDataFrame([("a", "empty_output", 0, 2, 0), ("a", "json_decode_error", 2, 3, 1), ("b", "json_decode_error", 2, 0, 0), ("b", "schema_invalid", 3, 0, 0)], "variant string, failure string, ord int, n long, at_token_cap long")
    assert render.failures(counts).split("\n") == ["| variant | invalid | empty_output | json_decode_error | at token cap |", "|---|---|---|---|---|", "| a | 5 | 2 | 3 | 1 |", "| b | 0 | 0 | 0 | - |"]
    assert render.failures(counts.where("n = 0")) == "No variant has an invalid row."


def test_ceilings_and_uncertainty(spark):
    found = spark.createDataFrame([("tech_expected", 542, 153, 115, 41, 0.2823, 0.3565), ("tech_optional", 0, 0, 0, 0, None, None)], "field string, terms long, present long, records long, unanswerable long, share double, unanswerable_share double")
    best = spark.createDataFrame([("tech_expected", 0.2)], "field string, best_recall double")
    assert render.ceilings(found, best).split("\n")[2:] == ["| tech_expected | 542 | 153 | 0.28 | 115 | 41 (0.36) | 0.20 | 71% |", "| tech_optional | 0 | 0 | - | 0 | 0 (-) | - | - |"]
    assert render.ceilings(found).count("|---") == 6
    spans = spark.createDataFrame([("a", 0.1, 0.3, None, None)], "variant string, f1_low double, f1_high double, validity_low double, validity_high double")
    points = spark.createDataFrame([("a", 0.2, None)], "variant string, headline_f1 double, validity double")
    assert render.intervals(spans, points).split("\n")[2] == "| a | 0.20 | [0.10, 0.30] | - | [-, -] |"
    kind = "variant string, metric string, observed double, low double, high double, sign_agreement double, comparable boolean, separated boolean"
    paired = spark.createDataFrame([("b", "headline_f1", -0.2, -0.3, -0.1, 1.0, True, True), ("b", "validity", 0.0, -0.1, 0.1, 0.5, True, False), ("c", "validity", 0.1, 0.1, 0.2, 1.0, False, False)], kind)
    text = render.separation(paired)
    assert [line.split(" | ")[-1] for line in text.split("\n")[2:5]] == ["yes |", "no |", "n/a |"] and text.endswith("not comparable: c.")


def test_agreement_and_buckets(spark):
    found = spark.createDataFrame([("all", "n", 4.0), ("seniority", "kappa", 0.5), ("seniority", "agreement", None)], "field string, metric string, value double")
    assert render.agreement(found).split("\n") == ["| field | n | agreement | kappa |", "|---|---|---|---|", "| all | 4.00 | - | - |", "| seniority | - | - | 0.50 |"]
    cells = spark.createDataFrame([("work_mode", "all_agree", 1), ("work_mode", "platform_gap_caught", 1), ("total", "all_agree", 2)], "field string, bucket string, n long")
    assert render.triangulation(cells).split("\n")[2:] == ["| total | 2 | 0 | 0 | 0 |", "| work_mode | 1 | 1 | 0 | 0 |"]


def test_sink(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([("ż", 1.5), ("a", None)], "k string, v double")
    for title in ("First", "Second"):
        render.write_report(spark, str(tmp_path), title, {"One": "text", "Two": "more"}, {"rows": frame})
    assert (tmp_path / "report.md").read_text() == "# Second\n\n## One\n\ntext\n\n## Two\n\nmore\n"
    assert json.loads((tmp_path / "report.json").read_text()) == {"rows": [{"k": "a", "v": None}, {"k": "ż", "v": 1.5}]}
    assert not [p for p in tmp_path.iterdir() if ".part" in p.name and not p.name.startswith(".")]
    monkeypatch.setattr(render, "MOST_ROWS", 1)
    with pytest.raises(ValueError):
        render.write_report(spark, str(tmp_path), "t", {}, {"rows": frame})
