"""Reading and writing of records: JSON lines, alias dictionaries, prediction files by variant, frozen data sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import strip


def read_strict(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array in a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_variants(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All prediction files of a folder, with ``variant`` from the file's name."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder)
    return rows.withColumn("variant", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))


def load_completed(lines: DataFrame, key: str, schema: str, required: Sequence[str] = (), matches: Callable[[], Column] | None = None) -> DataFrame:
    """Usable rows of ``lines (pos, line)``: last row of each key, in the place of the first.

    Torn lines, lines without the key or a required key, and those that ``matches`` refuses are dropped. A required key may
    be null, it has to be there.
    """
    parsed = lines.where(strip(F.col("line")) != "").withColumn("row", F.from_json("line", schema)).withColumn("keys", F.json_object_keys("line"))
    for name in (key, *required):
        parsed = parsed.where(F.array_contains("keys", name))
    parsed = parsed.select("pos", "row.*").where(F.col(key).isNotNull())
    if matches is not None:
        parsed = parsed.where(matches())
    columns = [c for c in parsed.columns if c != "pos"]
    last = parsed.groupBy(key).agg(F.min("pos").alias("pos"), F.max_by(F.struct(*columns), "pos").alias("last"))
    return last.select("pos", "last.*")


def under_cap(cap: int | None) -> Column:
    """Whether a row was decoded under this token cap; no cap is a cap of its own."""
    return F.col("max_tokens").eqNullSafe(F.lit(cap))


def todo(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key), key, "left_anti")


def finished(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Completed rows of the wanted keys, with the place they are wanted in."""
    return done.drop("pos").join(wanted.select(key, "pos"), key)


def backup_suffix(rows: DataFrame, required: Sequence[str]) -> str:
    """Suffix for a copy of superseded rows: their caps, or what they lack."""
    present = [F.coalesce(F.bool_and(F.array_contains("keys", k)), F.lit(False)) for k in required]
    state = rows.agg(F.sort_array(F.collect_set("max_tokens")).alias("caps"), *(p.alias(f"p{i}") for i, p in enumerate(present))).first()
    if state["caps"]:
        return ".cap" + "-".join(map(str, state["caps"]))
    return ".uncapped" if required and all(state[f"p{i}"] for i in range(len(present))) else ".pre-taxonomy"


def aliases(spark: SparkSession, names: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """``(alias, canonical, ord)``: each name and its spellings, lower-cased; of equal spellings the last one counts, in the
    place of the first. The dictionary's size is fixed, some hundred entries."""  # noqa: D205
    index: dict[str, str] = {}
    for canonical, spellings in names.items():
        for spelling in (canonical, *(spellings or ())):
            index[str(spelling).strip().lower()] = str(canonical).strip().lower()
    rows = [(a, c, i) for i, (a, c) in enumerate(index.items())]
    return spark.createDataFrame(rows, "alias string, canonical string, ord int")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one small dictionary file
    return aliases(spark, yaml.safe_load(text) or {})


def write_jsonl(rows: DataFrame, path: str, *by: str) -> None:
    """JSON lines with nulls kept, one folder per value of ``by``."""
    rows.write.option("ignoreNullFields", False).partitionBy(*by).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON lines of a run, or None where it has never run."""
    return read_strict(spark, path, schema) if exists(spark, path) else None


def append_missing(rows: DataFrame, path: str, key: str, schema: str) -> None:
    """Append the rows whose key the sink does not hold yet; a sink that is not there is made.

    A line torn by a run that stopped has no key, so its row is written again; readers drop the torn one.
    """
    if not exists(rows.sparkSession, path):
        return write_jsonl(rows, path)
    lines = rows.sparkSession.read.text(path).select(F.from_json("value", schema).alias("row"))
    done = lines.select(f"row.{key}").where(F.col(key).isNotNull())
    todo(rows, done, key).write.mode("append").option("ignoreNullFields", False).json(path)


def backup_once(spark: SparkSession, path: str, suffix: str) -> bool:
    """Copy a sink beside itself, unless such a copy is there already; whether it was made."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(path), fs.Path(path.rstrip("/") + suffix)
    conf = spark._jsc.hadoopConfiguration()
    if not exists(spark, path) or target.getFileSystem(conf).exists(target):
        return False
    return fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)


def backup_superseded(path: str, kept: DataFrame, existing: DataFrame, required: Sequence[str]) -> bool:
    """Copy a sink, with the suffix of what is superseded, if and only if rows will be dropped from it."""
    if kept.count() >= existing.count():
        return False
    dropped = existing.join(kept.select("pos"), "pos", "left_anti")
    return backup_once(kept.sparkSession, path, backup_suffix(dropped, required))


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` under exactly this schema; an unknown or a missing column is a TypeError."""
    wanted = rows.sparkSession.createDataFrame([], schema).schema
    unknown, missing = set(rows.columns) - set(wanted.names), set(wanted.names) - set(rows.columns)
    if unknown or missing:
        raise TypeError(f"unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    return rows.to(wanted)


def frozen_records(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both parts of a frozen data set, in the order of ``(part, pos)``: the training part first."""
    return train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)))


def flat_gold(records: DataFrame, fields: Sequence[str], id_col: str = "offer_id") -> DataFrame:
    """The gold fields beside the id, nothing else."""
    return records.select(id_col, *(F.col(f"gold.{f}").alias(f) for f in fields))


def head_limit(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows in this order, for trial runs; 0 stands for all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return rows.orderBy(*order).limit(limit) if limit else rows


def hard_cap(rows: DataFrame, cap: int) -> DataFrame:
    """``rows``, or an error where there are more than ``cap``: what must not leave in larger numbers."""
    if cap < 0:
        raise ValueError("cap must not be negative")
    if len(rows.limit(cap + 1).select(F.lit(1)).take(cap + 1)) > cap:
        raise ValueError(f"more than {cap} rows")
    return rows


def markdown(report: DataFrame, *order: str) -> str:
    """A report of few rows (variants or fields) as a table of text."""
    rows = report.orderBy(*order).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [report.columns, ["-"] * len(report.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def manifest(records: DataFrame, min_prose_chars: int, test_fraction: float) -> DataFrame:
    """One row per split, with its rows and dates; an empty split has null dates."""
    spark = records.sparkSession
    splits = spark.createDataFrame([("train",), ("test",)], "split string")
    counted = records.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("pub_date").alias("first_date"), F.max("pub_date").alias("last_date"))
    out = splits.join(counted, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("min_prose_chars", F.lit(min_prose_chars)).withColumn("test_fraction", F.lit(test_fraction))


def sitemap_urls(sitemaps: DataFrame, pattern: str, column: str = "xml") -> DataFrame:
    """``(pos, url)`` of every ``<loc>`` whose address fits ``pattern``."""
    found = F.regexp_extract_all(F.col(column), F.lit(f"<loc>({pattern})</loc>"), F.lit(1))
    return sitemaps.select(F.posexplode(found).alias("pos", "url"))


def one_of_each_key(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key where rows have a ``pos``; without one, a repeated key fails the job."""
    if pos in rows.columns:
        return last_wins(rows, key, pos)
    held = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*(c for c in rows.columns if c != key))).alias("__row"))
    sole = F.assert_true(F.col("__n") == 1, F.concat(F.lit("repeated key without an order: "), F.col(key).cast("string")))
    return held.where(sole.isNull()).select(key, "__row.*")  # the key itself, by which rows stay partitioned


def last_wins(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(pos)))
    return rows.withColumn("__n", place).where("__n = 1").drop("__n")
