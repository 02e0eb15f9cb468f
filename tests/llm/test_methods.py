"""Runs of lines over many batches, captures with odd ids, places of very many matches, and ownership of secrets."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievemark.llm._spans import located
from sievemark.llm.line_dedup import LineRuns, drop_common_lines
from sievemark.llm.secrets import secret_scan
from sievemark.llm.warc import archive_pages


def test_line_runs_compact_and_count(spark):
    texts = [[f"l{(b * 7 + i * i) % 50}" for i in range(20)] + [f"own{b}"] for b in range(9)]
    runs, seen, counts = LineRuns(spark, buckets=3, fanout=3), set(), Counter()
    for lines in texts:
        batch = spark.createDataFrame([("\n".join(lines),), ("l1\nl1",)], "text string")
        fresh = runs.add_batch(batch)
        own = set(lines) | {"l1"}
        counts.update(set(lines))
        counts["l1"] += 1
        assert fresh.count() == len(own - seen)
        seen |= own
    assert runs.compactions >= 4 and len(runs.runs()) < 9
    got = sorted(r.n_docs for r in runs.counts().collect())
    assert got == sorted(counts.values())
    two = (spark.table(runs.runs()[0]), runs._write(runs.counts().repartition(3, "line")))
    plan = two[0].join(spark.table(two[1]), "line", "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_the_query_compacts(spark, monkeypatch):
    made = []
    close = LineRuns.close
    monkeypatch.setattr(LineRuns, "close", lambda self: (made.append(self.compactions), close(self)))
    docs = spark.createDataFrame([(i, f"a\nb{i % 3}\nc{i}") for i in range(40)], "doc_id long, text string")
    got = {r.id: r.kept_text for r in drop_common_lines(docs, min_docs=10, first_batch=2).collect()}
    assert got == {i: f"c{i}" for i in range(40)} and made[0] >= 1


def test_rows_of_one_id_are_one_document(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(7, "a\nb")] * 10 + [(i, "a") for i in range(20, 28)] + [(None, "a\nn"), (None, "n")], schema)
    for batch in (1, 3, 1000):
        assert {(r.id, r.n_dropped) for r in drop_common_lines(same, min_docs=10, first_batch=batch).collect()} == {(7, 1), (None, 1), (None, 0), *((i, 1) for i in range(20, 28))}
        assert {r.n_dropped for r in drop_common_lines(same, min_docs=11, first_batch=batch).collect()} == {0}
    runs = LineRuns(spark, buckets=2)
    assert runs.add_batch(same, id_col="doc_id").groupBy("n_docs").count().collect() and sorted(r.n_docs for r in runs.counts().collect()) == [1, 1, 10]
    runs.close()


def test_a_text_of_very_many_lines(spark):
    import time

    n = 400_000
    rows = [(0, "\n".join(["x"] * n)), (1, "\n".join(f"y{i}" if i % 2 else "x" for i in range(n))), (2, "x")]
    docs, began = spark.createDataFrame(rows, "doc_id long, text string"), time.time()
    got = {r.id: r for r in drop_common_lines(docs, min_docs=3).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].kept_text) == (n, n, "")
    assert (got[1].n_dropped, got[1].kept_text) == (n // 2, "\n".join(f"y{i}" for i in range(1, n, 2))) and got[2].kept_text == ""
    assert time.time() - began < 60


def test_shards_are_the_same_when_sorts_spill(spark, sf):
    from sievemark.llm.token_shards import shard_rows, write_shards

    docs, name = spark.read.parquet(f"{sf}/documents.parquet"), "spark.shuffle.spill.numElementsForceSpillThreshold"
    content = lambda x: {r.shard: bytes(r.content) for r in spark.read.format("binaryFile").option("basePath", x.path).load(x.path).select("shard", "content").collect()}
    calm = write_shards(docs, length=64, per_shard=400)
    want = content(calm)
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()  # no session may set it; this test runs in one process
    conf.set(name, "50")
    try:
        spilt = write_shards(docs, length=64, per_shard=400)
    finally:
        conf.remove(name)
    assert content(spilt) == want and len(want) > 3
    assert shard_rows(spark, spilt).count() == spilt.index.count()


def test_a_record_in_another_slot_is_refused(spark, sf):
    import dataclasses

    from sievemark.llm.token_shards import shard_rows, write_shards

    shards = write_shards(spark.read.parquet(f"{sf}/documents.parquet"), length=512, per_shard=100)
    n = shards.index.count()
    wrong = dataclasses.replace(shards, index=shards.index.withColumn("slot", F.pmod(F.col("slot") + 1, F.lit(n))))
    with pytest.raises(Exception, match="another record lies at slot"):
        shard_rows(spark, wrong).collect()


def test_token_query_against_plain_python(spark, sf):
    """The table is read in one partition, so its sequences follow from the texts in their order."""
    import hashlib

    import tiktoken

    from sievemark.llm import queries
    from sievemark.llm.token_shards import END, PATTERN, TOKENIZER, Feistel, read_ranks

    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert table.rdd.getNumPartitions() == 1
    encode = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=read_ranks(TOKENIZER), special_tokens={}).encode_ordinary
    stream = [(x, r.doc_id) for r in table.collect() for x in (*encode(r.text or ""), END)]
    parts, length = [stream[i : i + 8192] for i in range(0, len(stream), 8192)], 8192
    slots = Feistel(len(parts), "training-order").slot(range(len(parts)))
    want = set()
    for slot, part in zip(slots.tolist(), parts):
        ids = [x for x, _ in part] + [END] * (length - len(part))
        digest = hashlib.sha256(b"".join(x.to_bytes(2, "little") for x in ids)).hexdigest()
        want.add((slot, len(part), len({d for _, d in part}), part[0][1], slot // 1024, slot % 1024 * (2 * length + 2), digest))
    got = queries.op7_token_shards(spark, sf).select("slot", "n_tokens", "n_docs", "first_id", "shard", "at", "ids_sha256")
    assert {tuple(r) for r in got.collect()} == want


def test_captures_of_any_id(spark):
    ids = [2**62, 2**60, -5, None, None, 7, 7, 10**12]
    pages = spark.createDataFrame([(i, "http://a.example/\r\nx", f"p{n}" if n % 2 else "same") for n, i in enumerate(ids)], "page_id long, url string, html string")
    got = archive_pages(pages).collect()
    assert len(got) == len(ids) and {r.url_key for r in got} == {"example,a)/%0d%0ax"}
    assert sorted(r.page_id for r in got) == sorted("null" if i is None else str(i) for i in ids)
    same = [r for r in got if r.payload_bytes == 4]
    assert {(r.page_id, r.record_type, r.refers_to) for r in same} == {(str(2**62), "revisit", "-5"), ("-5", "response", None), ("null", "revisit", "-5"), ("7", "revisit", "-5")}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 101])
def test_places(spark, n):
    text = "é".join(f"{'x' * (i % 4)}<{i}>" for i in range(n)) + " end"
    frame = spark.createDataFrame([(text,)], "t string").select(located(F.col("t"), "<[0-9]+>").alias("x"))
    assert [(r.begin, r.value) for r in frame.first().x] == [(m.start(), m[0]) for m in re.finditer("<[0-9]+>", text)]


def test_secrets_of_few_and_many(spark):
    value = lambda c: f"{c}bCdEfGh1JkLmNoPqRsT9Z"
    rows = [(i, f"x {value('A')} y", "s1", "en") for i in range(2)] + [(10 + i, f"{value('B')}", "s1", f"l{i}") for i in range(4)] + [(20 + i, value("C"), f"s{i}", "en") for i in range(2)]
    got = {r.id: (r.spans, r.n_live, r.n_copied) for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert got == {i: ("opaque:2:24", 1, 0) for i in range(2)} | {10 + i: ("", 0, 1) for i in range(4)} | {20 + i: ("", 0, 1) for i in range(2)}
