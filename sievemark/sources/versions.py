"""Folders that change as a whole: a version is staged, checked and then committed by one small file.

``root`` holds a folder for each version and ``committed-<n>.json`` for each that was committed. The committing file is
written beside and renamed, which every file system does as a whole or not at all; readers take the last one. What a writer
that was stopped has left is in no committed version, so it is never read, and the version before stays readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .records import hard_cap, read_strict, write_jsonl


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Write a small file as a whole. Where it is there already: with ``replace`` it is exchanged, else false and unchanged."""
    (temporary, fs), (target, _) = _path(spark, f"{path}.{uuid.uuid4().hex}.part"), _path(spark, path)
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    if replace:
        fs.delete(target, False)
    done = not fs.exists(target) and fs.rename(temporary, target)
    if not done:
        fs.delete(temporary, False)
    return done


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())  # one small file


def write_slice(rows: DataFrame, path: str, most: int = 100_000) -> bool:
    """A bounded slice as one indented JSON array, for people to read; more than ``most`` rows are an error."""
    found = [r.asDict(recursive=True) for r in hard_cap(rows, most).collect()]
    return put_text(rows.sparkSession, path, json.dumps(found, ensure_ascii=False, indent=2, default=str))


@dataclass(frozen=True)
class Versions:
    spark: SparkSession
    root: str

    def committed(self) -> list[int]:
        where, fs = _path(self.spark, self.root)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[len("committed-") : -len(".json")]) for n in names if n.startswith("committed-") and n.endswith(".json"))

    def current(self) -> dict | None:
        """What the last commit says; None before the first."""
        found = self.committed()
        return json.loads(get_text(self.spark, f"{self.root}/committed-{found[-1]:08d}.json")) if found else None

    def staged(self) -> str:
        """A folder for a version to be; no other writer gets it."""
        return f"{self.root}/version-{uuid.uuid4().hex[:12]}"

    def commit(self, info: Mapping) -> dict:
        """Make a version the current one. Of two writers that began from the same version the second fails."""
        number = (self.committed() or [-1])[-1] + 1
        whole = {**info, "number": number}
        if not put_text(self.spark, f"{self.root}/committed-{number:08d}.json", json.dumps(whole, ensure_ascii=False, indent=2)):
            raise RuntimeError(f"version {number} of {self.root} was committed by another writer")
        return whole


def _digest(spark: SparkSession, path: str) -> dict:
    """Number of lines and a sum over them that no order of the lines changes."""
    lines = spark.read.text(path).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))
    return lines.first().asDict()


def freeze(parts: Mapping[str, DataFrame], root: str, info: Mapping | None = None) -> dict:
    """Write the parts of a data set as JSON lines, count and digest what was written, and commit them together.

    Stopped at any point before the commit, the version before is what readers get. An empty part is a part of no rows.
    """
    spark = next(iter(parts.values())).sparkSession
    versions = Versions(spark, root)
    folder, held = versions.staged(), {}
    for name, rows in parts.items():
        write_jsonl(rows, f"{folder}/{name}")
        held[name] = {**_digest(spark, f"{folder}/{name}"), "schema": rows.schema.jsonValue()}
    return versions.commit({**(info or {}), "folder": folder.rpartition("/")[2], "parts": held})


def read_frozen(spark: SparkSession, root: str, part: str, verify: bool = True) -> DataFrame:
    """A part of the committed version. Without a commit, or if the files are not what was committed, an error."""
    current = Versions(spark, root).current()
    if current is None:
        raise FileNotFoundError(f"{root} holds no committed data set")
    path, held = f"{root}/{current['folder']}/{part}", current["parts"][part]
    if verify and _digest(spark, path) != {"n": held["n"], "digest": held["digest"]}:
        raise ValueError(f"{path} is not what was committed")
    schema = StructType.fromJson(held["schema"])
    return read_strict(spark, path, schema) if held["n"] else spark.createDataFrame([], schema)
