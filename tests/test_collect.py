"""Pages one by one with their errors, reasons in one pass, samples of sparse places, and the review queue."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sievemark.functions import vocab
from sievemark.operators import curate

PAGE = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"offer":{"id":"%s","jsonSections":[{"title":"T","model":{"paragraphs":["p"]}}]}}}}</script>'


def fetcher():
    asked = []

    def fetch(url):
        asked.append(url)
        if url is None or url.startswith("bad"):
            raise OSError(f"no answer from {url}")
        return PAGE % url if url.startswith("offer") else "<p>nothing</p>"

    return fetch


def test_errors_stay_with_their_page(spark, tmp_path):
    urls = spark.createDataFrame([(i, u, "x") for i, u in enumerate(["offer1", "bad1", "other", None, "offer2", "bad2"])], "n int, url string, error string").repartition(3)
    pages = curate.fetched_pages(urls, fetcher)
    got = {r.n: r for r in pages.collect()}
    assert len(got) == 6 and got[1].error == "OSError: no answer from bad1" and got[1].html is None and got[0].error is None
    seen = Observation()
    curate.judged_pages(pages, seen=seen).write.parquet(str(tmp_path / "judged"))
    assert seen.get == {"requested": 6, "fetch_failed": 3, "unusable_page": 1, "usable": 2}
    kept = spark.read.parquet(str(tmp_path / "judged"))
    assert sorted(r.offer_id for r in kept.where("reason = 'usable'").collect()) == ["offer1", "offer2"]
    assert {r.offer_id for r in curate.parse_pages(pages).collect()} == {"offer1", "offer2"}
    assert curate.fetched_pages(urls.limit(0), fetcher).count() == 0


def test_collection_is_one_scan(spark, tmp_path):
    spark.createDataFrame([("a", PAGE % 1), ("b", None), ("c", "")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    stats = curate.collection_stats(spark.read.parquet(str(tmp_path / "pages")))
    assert stats._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert tuple(stats.first()) == (3, 1, 1, 1, "requested 3: fetch_failed 1, unusable_page 1, usable 1")


@pytest.mark.parametrize("n", [1, 3, 7, 10, 11])
def test_spread_over_sparse_places(spark, n):
    places = [5, 7, 100, 101, 102, 9000, 9001, 12000, 12001, 50000]
    rows = spark.createDataFrame([(p,) for p in places], "pos long").repartition(4)
    step = max(1, len(places) // n)
    assert sorted(r.pos for r in curate.spread_sample(rows, n).collect()) == (places[::step][:n] if n < len(places) else places)
    ranks = curate.ranked(rows, "pos").collect()
    assert [r.rank for r in sorted(ranks)] == list(range(10))


def test_review_queue(spark):
    records = spark.createDataFrame([(i, f"prose {i}") for i in range(5)], "offer_id long, prose string")
    proposals = spark.createDataFrame([(3, "three")], "offer_id long, parsed string")
    flags = spark.createDataFrame([(3, True), (1, False)], "offer_id long, any boolean")
    sample = spark.createDataFrame([(4, 0), (3, 1), (1, 2)], "offer_id long, pos int")
    queue = curate.review_queue(sample, records, proposals, flags)
    assert [(r.offer_id, r.parsed, r.any) for r in queue.collect()] == [(4, None, None), (3, "three", True), (1, None, False)]
    label = queue.first().human_gold
    assert label.title is None and label.salary is None and all(label[f] == [] for f in (*vocab.SET_FIELDS, "contract_types"))
    assert curate.review_queue(sample.select("offer_id"), records, proposals, flags).withColumn("x", F.lit(1)).count() == 3
