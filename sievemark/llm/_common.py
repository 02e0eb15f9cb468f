"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters of the class [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (tests) is a temporary folder made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-sievemark-"))
            known = spark.sparkContext.getCheckpointDir()
        root = known
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; what is still there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/sievemark-{name}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


#: Scratch paths of the scope that is open in this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Gathers the scratch paths made inside, for ``delete_path`` once nothing reads them any more."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(before)


@contextmanager
def session_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings of the session (``__`` for a dot) that hold inside and are put back afterwards."""
    names = {name.replace("__", "."): value for name, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20):
    """Inside, Arrow batches of what is run are bounded by rows and bytes, so that long texts do not make large ones."""
    return session_settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(rows), spark__sql__execution__arrow__maxBytesPerBatch=str(size))


def write_parquet(df: DataFrame, path: str, *partition_by: str, **options: str) -> DataFrame:
    """Write ``df`` and read it back; the shuffles of the write go when it has ended, as nothing can read them again."""
    with session_settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.options(**options).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    table = write_parquet(df, path, *partition_by)
    table.scratch = path
    return table


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` whose results have been written; nothing may read them any more."""
    for table in tables:
        delete_path(table.sparkSession, table.scratch)


#: Keys up to this number are sent to all tasks; beyond it the same join is dealt by key.
BROADCAST_KEYS = 1_000_000


def restricted(frame: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of ``frame`` with ``keys``, broadcast where they are few, so that wide rows need not move."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return frame.join(F.broadcast(keys) if few else keys, on, how)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the Arrow batches of this session by rows and bytes, so that long texts do not make large ones."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def row_key(*cols: str) -> Column:
    """128-bit key of a row's values; nulls are told apart from empty values.

    Rows with equal values share a key and get equal results, so repeated ids neither multiply nor vanish in joins.
    """
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts).cast("binary")))


def ascii_lower(x: Column) -> Column:
    """A-Z to a-z, nothing else.

    ``lower`` also folds letters beyond ASCII and is much faster than ``translate``; it is taken where the text has no
    upper-case letter beyond ASCII, so that both agree.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    beyond = F.rlike(x, F.lit(r"[\p{IsUppercase}\p{IsTitlecase}&&[^A-Z]]"))
    plain = F.octet_length(x) == F.length(x)
    return F.when(plain | ~beyond, F.lower(x)).otherwise(F.translate(x, upper, upper.lower()))


def strip_spaces(x: Column) -> Column:
    """All of ``[\\x20\\x09-\\x0D]`` away from both ends."""
    return F.btrim(x, F.lit(SPACES))
