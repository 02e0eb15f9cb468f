"""Queries of the plans read whole tables and whole texts."""

import datetime
import hashlib

import numpy as np

import sievemark.plans.queries as plans
import sievemark.plans.reports as reports
from sievemark.operators import bootstrap, curate, scoring


def test_extract_pages_searches_every_page_whole(spark, tmp_path):
    script = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"offer":{"id":"own%d","jsonSections":[{"title":"T","model":{"paragraphs":["p"]}}]}}}}</script>'
    filler = "<p>x</p>" * 5000
    rows = [(1, "u1", filler + script % 1), (2, "u2", filler + script % 2), (3, "u3", filler), (4, "u4", filler), (6, "u6", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.offer_id, r.url) for r in plans.extract_pages(spark, str(tmp_path)).collect()}
    assert got == {("own1", "u1"), ("own2", "u2"), ("4", "u4"), ("6", "u6")}


def test_set_scores_count_the_words_of_whole_texts(spark, tmp_path):
    """``n`` words of five letters are right, one of four is missed by b and one of seven is wrong in a, beyond any prefix."""
    words = [f"w{i:04d}" for i in range(5000)] + ["last", "sevenll"]
    spark.createDataFrame([(1, " ".join(words), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.variant: (r.tp, r.fp, r.fn) for r in plans.set_scores(spark, str(tmp_path)).where("field = 'tech_expected'").collect()}
    assert got == {"a": (5001, 1, 1), "b": (5001, 0, 1)}


def test_sets_cross_the_join_as_hashes(spark):
    """What is carried through the join is numbers; counts are those of the terms, with nulls, repeats, and null or invalid answers."""
    kind = "struct<tech_expected:array<string>,tech_optional:array<string>>"
    lists = [None, [], ["a"], ["a", "a", None, "b"], ["b", "", "ä"], ["a b", "b a"], ["c", "b", "a", "x" * 100]]
    gold = [(i * 7 + j, {"tech_expected": g, "tech_optional": h}) for i, g in enumerate(lists) for j, h in enumerate(lists)] + [(49, None)]
    preds = [(v, k, ok, {"tech_expected": lists[(k + v) % 7], "tech_optional": lists[k % 5]}) for v in (0, 1) for k in range(50) for ok in (True, False, None)] + [(1, 3, True, None), (0, 49, True, None)]
    preds = spark.createDataFrame(preds, f"variant int, offer_id long, valid boolean, parsed {kind}")
    gold = spark.createDataFrame(gold, f"offer_id long, gold {kind}")
    fields = ("tech_expected", "tech_optional")
    rows = scoring.matched(preds, gold, fields=fields)
    assert {rows.schema[side].dataType[f].dataType.elementType.typeName() for side in ("parsed", "gold") for f in fields} == {"long"}

    answers = {r.offer_id: r.gold for r in gold.collect()}
    as_set = lambda row, f: {t for t in (row and row[f]) or () if t is not None}
    want = {}
    for r in preds.collect():
        for f in fields:
            p, g = as_set(r.parsed if r.valid else None, f), as_set(answers[r.offer_id], f)
            own = (len(p & g), len(p - g), len(g - p), int(bool(g) and p == g), int(bool(g)), int(bool(p)), 1)
            want[r.variant, f] = tuple(map(sum, zip(want.get((r.variant, f), (0,) * 7), own)))
    for sides in (rows, scoring.matched(preds, gold)):
        got = {(r.variant, r.field): (r.tp, r.fp, r.fn, r.exact_supported, r.support, r.n_pred_nonempty, r.n) for r in scoring.set_scores(sides, fields).collect()}
        assert got == want


def test_bootstrap_draws_2000_resamples(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(bootstrap, "intervals", lambda metrics: seen.append(metrics) or metrics)
    plans.bootstrap_intervals(spark, sf)
    rows = seen[0].collect()
    assert {(r.variant, r.b) for r in rows} == {(v, b) for v in "ab" for b in range(2000)} and len(rows) == 4000
    # doc_id 0 to 199: 171 of a are valid
    own = np.array([r.validity for r in rows if r.variant == "a"])
    share = 171 / 200
    assert abs(own.mean() - share) < 0.003 and abs(own.std() - (share * (1 - share) / 200) ** 0.5) < 0.002


def test_bootstrap_weights_are_draws_with_replacement():
    n, chunk, b = 250, 100, range(3000)
    w = np.hstack([bootstrap._weights(n, at, b, "s", chunk) for at in range(3)])
    assert w.shape == (3000, n) and (w.sum(axis=1) == n).all()
    assert abs(w.mean(axis=0) - 1).max() < 0.1 and abs(w.var(axis=0) - (1 - 1 / n)).max() < 0.2
    assert abs(np.corrcoef(w[:, 0], w[:, 240])[0, 1]) < 0.1


def _counted(spark, rows):
    """``rows``, and an accumulator of the rows that were worked out, over all times that they were."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return rows.mapInArrow(run, rows.schema), seen


def test_frozen_split_works_its_records_out_once(spark, tmp_path, monkeypatch):
    """The documents are read for the keys of the deduplication and for the records, and not for the split or its parts."""
    text = lambda i: None if i % 13 == 0 else "" if i % 17 == 0 else f"words of {i % 40} " * 40
    rows = [(i, text(i), "en", None if i % 7 == 0 else "s") for i in range(1, 120)] + [(30, text(30), "en", "s"), (32, "other " * 100, "en", "s"), (None, text(3), "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, real = [], reports._examples

    def examples(spark, sf_dir):
        rows, n = _counted(spark, real(spark, sf_dir))
        seen.append(n)
        return rows

    monkeypatch.setattr(reports, "_examples", examples)
    got = [tuple(r) for r in reports.frozen_split(spark, str(tmp_path)).collect()]
    assert [n.value for n in seen] == [2 * len(rows)]

    taken, texts = [], {}  # ids that come twice are one place, so that neither row is before the other
    for i, t, _, source in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if t and len(t) >= 400 and i % 11 and i % 9 and source is not None and texts.setdefault(t, i) == i:
            taken.append((i, t))
    assert len(got) == len(taken) and sorted((i, p) for i, _, p in got) == sorted((i, hashlib.md5(t.encode()).hexdigest()) for i, t in taken)
    late = sorted(((datetime.date(2024, 1, 1) + datetime.timedelta(i % 365), i) for i, _ in taken), reverse=True)[: round(len(taken) * 0.2)]
    assert {i for i, s, _ in got if s == "test"} == {i for _, i in late}


def test_splits_count_their_rows_while_they_order_them(spark):
    """Range partitioning reads what it puts in order twice, for its bounds and to deal it; nothing else reads it before the result."""
    for n, share, want in ((0, 0.5, 0), (1, 0.5, 0), (2, 0.01, 1), (2, 0.99, 1), (10, 0.25, 2), (10, 0.99, 9), (30, 0.1, 3)):
        for split, late in ((curate.temporal_split, "test"), (curate.dev_split, "dev")):
            rows = spark.range(n).selectExpr("id AS pos", "id AS offer_id", "IF(id % 5 = 0, NULL, cast(id % 7 AS string)) AS pub_date")
            rows, seen = _counted(spark, rows.repartition(2))
            made = split(rows, share)
            assert seen.value == 2 * n
            newest = sorted(made.collect(), key=lambda r: (r.pub_date or "", r.pos), reverse=True)
            assert [r.split for r in newest] == [late] * want + ["train"] * (n - want)
