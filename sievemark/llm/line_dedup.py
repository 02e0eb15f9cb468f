"""Line deduplication over levelled sorted runs of line hashes.

A run is a table ``(line, n_docs)`` of 128-bit line keys, bucketed and sorted by the key. Each batch of documents is
merge-anti-joined with all runs: keys that none of them holds become the batch's own run, so no key is in two runs, and counts
of known keys go to a run of additions beside it. When a level holds ``fanout`` runs they are written as one run of the next
level, so a corpus of b batches keeps about log(b) levels and each key is rewritten that often. Runs share their bucketing:
the anti-joins and the last sums, of each run with the additions, move no run's rows. Two uses share the runs:

* ``LineRuns.add_batch`` returns the lines of a batch that are new;
* ``drop_common_lines`` adds a corpus batch by batch, then drops every line whose key is counted in ``min_docs`` documents or
  more. Each batch is twice as large as the one before, so their number grows with the logarithm of the corpus.

A document is an id: rows that share one count once. All work is DataFrame expressions; what is shuffled for the counts is one
hash per distinct line of a document, summed on the map side, so a line that most documents carry costs no more than any.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, delete_path, discard, materialise, restricted, row_key, scratch_path, session_settings, strip_spaces, text_or_empty


def line_keys(text: Column) -> Column:
    """Array of the 128-bit keys of the lines; null stands for a line that is blank after stripping."""

    def key(line: Column) -> Column:
        plain = ascii_lower(strip_spaces(line))
        return F.when(plain != "", F.unhex(F.md5(plain.cast("binary"))))

    return F.transform(F.split(text, "\n", -1), key)


@dataclass
class LineRuns:
    """Sorted runs by level, as tables in the shared folder; ``close`` deletes them.

    ``buckets`` is taken from the session's number of shuffle partitions, which follows the size of the corpus.
    """

    spark: SparkSession
    buckets: int = 0
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)
    added: list[list[str]] = field(default_factory=list)
    compactions: int = 0
    _paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, counts: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex[:12]}", scratch_path(self.spark, "line-run")
        writer = counts.write.bucketBy(self.buckets, "line").sortBy("line").format("parquet")
        with session_settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            writer.option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, self._paths.pop(name))

    def close(self) -> None:
        self._drop(*list(self._paths))
        self.levels, self.added = [], []

    def _place(self, levels: list[list[str]], run: str, disjoint: bool) -> None:
        """Put a run on level 0 and merge the levels that are full."""
        level = 0
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                return
            full, levels[level] = levels[level], []
            run, level = self._merged(full, disjoint), level + 1
            self.compactions += 1

    def _merged(self, names: list[str], disjoint: bool) -> str:
        """One run of several, which go. Additions may share keys; they are dealt into the buckets and summed there."""
        if len(names) == 1:
            return names[0]
        rows = reduce(DataFrame.unionByName, map(self.spark.table, names)).repartition(self.buckets, "line")
        # this version of Spark takes a union of bucketed tables for dealt by bucket, drops the repartition, and then reads
        # the tables without their buckets, which gives wrong sums
        with session_settings(self.spark, spark__sql__unionOutputPartitioning="false"):
            merged = self._write(rows if disjoint else rows.groupBy("line").agg(F.sum("n_docs").alias("n_docs")))
        self._drop(*names)
        return merged

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def counts(self) -> DataFrame:
        """``(line, n_docs)`` over all runs: each key is in one, and meets the additions, bucket by bucket."""
        if not self.runs():
            return self.spark.createDataFrame([], "line binary, n_docs long")
        added = [name for level in self.added for name in level]
        if added:
            self.added = [[self._merged(added, False)]]

        def summed(name: str) -> DataFrame:
            run = self.spark.table(name)
            if not added:
                return run
            more = self.spark.table(self.added[0][0]).withColumnRenamed("n_docs", "more")
            return run.join(more, "line", "left").select("line", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"))

        return reduce(DataFrame.unionByName, map(summed, self.runs()))

    def add_counts(self, counts: DataFrame) -> str:
        """Add ``(line, n_docs)`` of a batch; the name of the run of its new keys."""
        batch = counts.repartition(self.buckets, "line")
        known = self.runs()
        if not known:
            own = self._write(batch)
        else:
            # the batch is dealt into the buckets of the runs once and marked in all of them
            marked = batch.withColumn("held", F.lit(False))
            for name in known:
                held = self.spark.table(name).select("line", F.lit(True).alias("here"))
                marked = marked.join(held, "line", "left").select("line", "n_docs", (F.col("held") | F.coalesce("here", F.lit(False))).alias("held"))
            marked = materialise(marked, "line-batch")
            again = self._write(marked.where("held").select("line", "n_docs").repartition(self.buckets, "line"))
            own = self._write(marked.where("not held").select("line", "n_docs").repartition(self.buckets, "line"))
            discard(marked)
            self._place(self.added, again, False)
        self._place(self.levels, own, True)
        return own

    def add_batch(self, batch: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
        """The lines of ``batch`` that no run holds, as rows ``(line, n_docs)``; they become the batch's run. Without an
        ``id_col`` each row is a document; with one, rows of an id must be in one batch."""  # noqa: D205
        lines = line_keys(text_or_empty(text_col)).alias("lines")
        counts = line_counts(batch.select(lines)) if id_col is None else document_counts(batch.select(row_key(id_col).alias("doc"), lines))
        counts = materialise(counts, "line-counts")
        fresh = counts
        for name in self.runs():
            fresh = fresh.join(self.spark.table(name), "line", "left_anti")
        fresh = materialise(fresh, "line-fresh")
        self.add_counts(counts)
        discard(counts)
        return fresh


def distinct_lines() -> Column:
    """A row for each different key of ``lines``, spelt in hexadecimal: Spark makes texts distinct by hash, bytes one by one."""
    return F.explode(F.array_distinct(F.transform(F.array_compact("lines"), F.hex)))


def document_counts(keyed: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """``(line, n_docs)`` of rows ``(doc, lines)``, an array of keys.

    ``repeated`` are the keys ``doc`` of more than one row, if they are known; only their lines are made distinct over rows.
    """
    if repeated is None:
        repeated = keyed.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    lines = lambda rows: rows.select("doc", distinct_lines().alias("line")).select("doc", F.unhex("line").alias("line"))
    once, again = lines(keyed.join(repeated, "doc", "left_anti")), lines(keyed.join(repeated, "doc", "left_semi")).distinct()
    return once.select("line").unionByName(again.select("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"))


#: Rows of the first batch.
FIRST_BATCH = 20_000


def drop_common_lines(docs: DataFrame, min_docs: int = 10, first_batch: int = FIRST_BATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, kept_text, n_lines, n_dropped)`` of each row of ``docs``, without the lines found in ``min_docs`` documents.

    Null and empty texts are one empty line. Lines that are blank after stripping have no key and always stay. Rows of one
    id are one document for the counts, a null id being an id like any other; each row gets its own result. Other columns,
    whatever their names, are ignored. An empty table gives an empty result. A line of any length is hashed whole, and the
    work on a text grows with its length, whatever the number of its lines.
    """
    spark = docs.sparkSession
    ids = docs.select(row_key(id_col).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    ids = materialise(ids.where("n > 1").withColumn("n", F.col("n") - 1), "line-repeats")
    total = docs.count()
    # batch b has 2**b of 2**batches - 1 equal parts of the ids' hashes
    batches = max(1, math.ceil(math.log2(total / first_batch + 1)))
    part = F.pmod(F.xxhash64("doc"), F.lit((1 << batches) - 1)) + 1
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("row", row_key("id", "text"))
    keyed = source.select("row", row_key("id").alias("doc"), line_keys(F.col("text")).alias("lines"))
    keyed = materialise(keyed.withColumn("batch", F.floor(F.log2(part)).cast("int")), "line-keys", "batch")
    repeated = ids.select("doc") if not ids.isEmpty() else None
    runs = LineRuns(spark)
    for batch in range(batches):
        rows = keyed.where(F.col("batch") == batch)
        runs.add_counts(document_counts(rows, repeated) if repeated is not None else line_counts(rows))
    common = materialise(runs.counts().where(F.col("n_docs") >= min_docs).select("line"), "common-lines")
    runs.close()
    places = keyed.select("row", F.posexplode("lines").alias("place", "line")).where("line is not null")
    # few keys go to all places; many are dealt by key, where Spark can split a line that very many documents have
    hits = restricted(places, common, "line").groupBy("row").agg(F.collect_set("place").alias("places"))
    hits = materialise(hits, "line-hits")
    discard(keyed, common, ids)
    lines = F.split("text", "\n", -1)
    # the generator makes arrays of the row once; inside a lambda alone the text would be split again for each line
    whole = F.array(F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places").alias("stay")))
    rows = source.join(hits, "row", "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>"))).select("id", "text", "places", F.inline(whole))
    kept = F.transform("stay", lambda i: F.get("lines", i))
    return rows.select(
        "id", "text", F.when(F.size("places") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("places").cast("long").alias("n_dropped"),
    )


def line_counts(keyed: DataFrame) -> DataFrame:
    """``document_counts`` where every row is a document of its own."""
    lines = keyed.select(distinct_lines().alias("line")).select(F.unhex("line").alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"))
