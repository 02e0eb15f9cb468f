"""Reports for people: the few rows of variants, fields and pairs as Markdown, and the sinks of reports.

What cannot be measured is a dash, never a number. Everything rendered here is one row for each variant, field or pair.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.versions import put_text

#: Rows that a report may have; more are no report.
MOST_ROWS = 10_000
Columns = Sequence[tuple[str, Callable[[Row], object]]]


def shown(value: object, digits: int = 2) -> str:
    """A cell: a dash for what is missing, fixed digits for numbers that are not whole, no bar that would end the cell."""
    if value is None:
        return "-"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def _rows(frame: DataFrame, *order: str) -> list[Row]:
    found = frame.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"a report has {MOST_ROWS} rows at most")
    return found


def table(rows: Sequence[Row], columns: Columns) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line([n for n, _ in columns]), "|" + "---|" * len(columns), *(line([shown(f(r)) for _, f in columns]) for r in rows)])


def _cell(name: str) -> Callable[[Row], object]:
    return lambda r: r[name]


def _span(low: str, high: str) -> Callable[[Row], str]:
    return lambda r: f"[{shown(r[low])}, {shown(r[high])}]"


def variants(report: DataFrame, scores: DataFrame) -> str:
    """The comparison of variants: ``report`` of ``scoring.report`` beside the F1 of the headline fields of ``set_scores``."""
    f1 = scores.groupBy("variant").agg(*(F.max(F.when(F.col("field") == f, F.col("f1"))).alias(f"f1_{f}") for f in vocab.HEADLINE_FIELDS))
    rows = _rows(report.join(f1, "variant", "left"), "variant")
    return table(rows, [
        ("variant", _cell("variant")), ("coverage", lambda r: shown(r["coverage"]) + ("" if r["trustworthy"] else " (!)")), ("valid JSON", _cell("json_validity")),
        *((f"{f} F1", _cell(f"f1_{f}")) for f in vocab.HEADLINE_FIELDS), ("salary found", _cell("detection")),
        ("currency/kind/amounts", lambda r: "/".join(shown(r[c]) for c in ("currency", "kind", "amounts"))), ("headline F1", _cell("headline_f1")),
        ("$ per 1k", _cell("cost_per_1k")), ("p50 s", _cell("latency_p50")), ("p95 s", _cell("latency_p95")),
    ])


def failures(counts: DataFrame) -> str:
    """Rows ``(variant, failure, ord, n, at_token_cap)``: a row for each variant, a column for each class that occurs."""
    found: dict[str, dict[str, Row]] = {}
    for r in _rows(counts, "variant", "ord"):
        found.setdefault(r["variant"], {})[r["failure"]] = r
    classes = [c for c in vocab.FAILURES if any(c in own and own[c]["n"] for own in found.values())]
    if not classes:
        return "No variant has an invalid row."
    of = lambda own, c, name="n": own[c][name] if c in own else 0
    rows = [
        Row(variant=v, invalid=sum(r["n"] for r in own.values()), capped=sum(r["at_token_cap"] for r in own.values()) or None, **{c: of(own, c) for c in classes})
        for v, own in found.items()
    ]
    return table(rows, [("variant", _cell("variant")), ("invalid", _cell("invalid")), *((c, _cell(c)) for c in classes), ("at token cap", _cell("capped"))])


def ceilings(found: DataFrame, best: DataFrame | None = None) -> str:
    """Rows of ``ceiling.ceilings``, with the best recall as a share of the ceiling where recalls are given."""
    whole = found if best is None else found.join(best, "field", "left")
    columns: list = [
        ("field", _cell("field")), ("terms", _cell("terms")), ("in the text", _cell("present")), ("ceiling", _cell("share")), ("records", _cell("records")),
        ("with none in the text", lambda r: f"{r['unanswerable']} ({shown(r['unanswerable_share'])})"),
    ]
    if best is not None:
        reached = lambda r: None if r["best_recall"] is None or not r["share"] else f"{r['best_recall'] / r['share']:.0%}"
        columns += [("best recall", _cell("best_recall")), ("reached", reached)]
    return table(_rows(whole, "field"), columns)


def intervals(found: DataFrame, points: DataFrame) -> str:
    """Rows of ``bootstrap.intervals`` beside the observed ``points (variant, headline_f1, validity)``."""
    rows = _rows(found.join(points.select("variant", "headline_f1", "validity"), "variant"), "variant")
    spans = ("F1 interval", _span("f1_low", "f1_high")), ("validity interval", _span("validity_low", "validity_high"))
    return table(rows, [("variant", _cell("variant")), ("headline F1", _cell("headline_f1")), spans[0], ("valid JSON", _cell("validity")), spans[1]])


def separation(found: DataFrame) -> str:
    """Rows of ``bootstrap.separation``; pairs that did not answer the same records are not judged."""
    verdict = lambda r: "n/a" if not r["comparable"] else "yes" if r["separated"] else "no"
    rows = _rows(found, "variant", "metric")
    columns = [("variant", _cell("variant")), ("metric", _cell("metric")), ("difference", _cell("observed")), ("interval", _span("low", "high"))]
    out = table(rows, [*columns, ("same sign", _cell("sign_agreement")), ("separated", verdict)])
    apart = sorted({r["variant"] for r in rows if not r["comparable"]})
    return f"{out}\n\nNot answered on all records, so not comparable: {', '.join(apart)}." if apart else out


def agreement(found: DataFrame) -> str:
    """Rows ``(field, metric, value)`` of two label sources: a row for each field, a column for each metric that occurs."""
    held: dict[str, dict[str, float]] = {}
    for r in _rows(found, "field", "metric"):
        held.setdefault(r["field"], {})[r["metric"]] = r["value"]
    metrics = list(dict.fromkeys(m for own in held.values() for m in own))
    rows = [Row(field=f, **{m: own.get(m) for m in metrics}) for f, own in held.items()]
    return table(rows, [("field", _cell("field")), *((m, _cell(m)) for m in metrics)])


def triangulation(found: DataFrame) -> str:
    """Rows ``(field, bucket, n)``: a row for each field, a column for each bucket."""
    buckets = ("all_agree", "platform_gap_caught", "llm_error", "all_differ")
    wide = found.groupBy("field").agg(*(F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("n"))), F.lit(0)).alias(b) for b in buckets))
    return table(_rows(wide, "field"), [("field", _cell("field")), *((b, _cell(b)) for b in buckets)])


def document(title: str, sections: Mapping[str, str]) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{text}" for name, text in sections.items())]) + "\n"


def write_report(spark: SparkSession, folder: str, title: str, sections: Mapping[str, str], tables: Mapping[str, DataFrame]) -> None:
    """``report.json`` with the rows of ``tables`` and ``report.md`` with the sections; each replaces the one before as a whole."""
    whole = {name: [r.asDict(recursive=True) for r in _rows(frame, *frame.columns[:2])] for name, frame in tables.items()}
    put_text(spark, f"{folder}/report.json", json.dumps(whole, ensure_ascii=False, indent=2, default=str), replace=True)
    put_text(spark, f"{folder}/report.md", document(title, sections), replace=True)
