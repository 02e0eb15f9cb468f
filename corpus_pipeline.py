"""From raw documents to token shards: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm._common import delete_path, scratch_path, scratch_scope, write_parquet
from sievemark.llm.decontaminate import decontaminate
from sievemark.llm.mixing import mix
from sievemark.llm.ngram_join import one_of_each
from sievemark.llm.quality import passing
from sievemark.llm.queries import shard_rows
from sievemark.llm.token_shards import write_shards

#: Scratch tables of stages, by their run (or the folder of the input, where stages are called one by one) and place.
_LEFT: dict[str, dict[int, list[str]]] = {}
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def _stage(spark: SparkSession, sf_dir: str, place: int) -> Iterator[None]:
    """A stage starts when the result of the one before has been written, so the tables of those before it can go."""
    left = _LEFT.setdefault(_RUN.get() or sf_dir, {})
    for earlier in [p for p in left if p < place]:
        for path in left.pop(earlier):
            delete_path(spark, path)
    with scratch_scope() as paths:
        yield
    left.setdefault(place, []).extend(paths)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    with _stage(spark, sf_dir, 0):
        return passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays."""
    with _stage(spark, sf_dir, 1):
        return one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    with _stage(spark, sf_dir, 2):
        return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares of their size to the power 0.7; those below their share are read again. Rows are in mixed order."""
    with _stage(spark, sf_dir, 3):
        return mix(docs, alpha=0.7, repeat=True).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; one row per sequence, read back from them."""
    with _stage(spark, sf_dir, 4):
        return shard_rows(spark, write_shards(docs))


STAGES = [
    ("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination),
    ("mixing sources", mixing), ("token ids", tokens),
]

#: No stage but the first could be put in SQL that ends on whole tables; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each run has folders of its own, and only what its result reads is left."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    outside = _RUN.set(scratch_path(spark, "run"))
    try:
        for name, stage in STAGES[:-1]:
            written = scratch_path(spark, "stage")
            docs = write_parquet(stage(spark, docs, sf_dir), written)
            if before:
                delete_path(spark, before)
            before = written
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _RUN.reset(outside)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
