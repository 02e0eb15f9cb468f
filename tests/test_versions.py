"""Sets that are frozen as a whole, and runs that go on where they stopped."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sievemark.sources import records
from sievemark.sources.versions import Versions, freeze, read_frozen, write_slice
from sievemark.streaming import resume
from sievemark.streaming.resume import Progress, resume_run

SCHEMA = "id string, raw string"


def parts(spark, n):
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.concat(F.lit("text\n"), F.col("id").cast("string"))).alias("prose"), F.array(F.lit("a")).alias("tags"))
    return {"train": rows.where("id % 4 <> 0"), "test": rows.where("id % 4 = 0")}


def test_freeze_and_read(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        read_frozen(spark, root, "train")
    first = freeze(parts(spark, 10), root, {"test_fraction": 0.25})
    assert first["parts"]["train"]["n"] == 7 and first["number"] == 0 and Versions(spark, root).current() == first
    assert [tuple(r) for r in read_frozen(spark, root, "test").orderBy("id").collect()] == [(0, None, ["a"]), (4, "text\n4", ["a"]), (8, "text\n8", ["a"])]
    second = freeze({"train": parts(spark, 3)["train"], "test": parts(spark, 0)["test"]}, root)
    assert second["number"] == 1 and read_frozen(spark, root, "train").count() == 2 and read_frozen(spark, root, "test").count() == 0
    assert read_frozen(spark, root, "test").columns == ["id", "prose", "tags"]


def test_a_stop_between_parts_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    old = freeze(parts(spark, 10), root)
    broken = parts(spark, 20)
    broken["test"] = broken["test"].withColumn("prose", F.raise_error(F.lit("stopped")))
    with pytest.raises(Exception, match="stopped"):
        freeze(broken, root)
    assert Versions(spark, root).current() == old and read_frozen(spark, root, "train").count() == 7


def test_changed_files_are_refused(spark, tmp_path):
    root = tmp_path / "set"
    held = freeze(parts(spark, 10), str(root))
    folder = root / held["folder"] / "train"
    one = next(f for f in sorted(os.listdir(folder)) if f.endswith(".json"))
    (folder / one).write_text((folder / one).read_text().replace("text", "next"))
    (folder / f".{one}.crc").unlink()
    with pytest.raises(ValueError, match="is not what was committed"):
        read_frozen(spark, str(root), "train")
    assert read_frozen(spark, str(root), "test").count() == 3


def test_two_writers(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    committed = versions.committed
    versions.commit({"a": 1})
    object.__setattr__(versions, "committed", lambda: [])  # this writer has not seen it
    with pytest.raises(RuntimeError):
        versions.commit({"a": 2})
    object.__setattr__(versions, "committed", committed)
    assert versions.current()["a"] == 1


def test_slice(spark, tmp_path):
    path = str(tmp_path / "slice.json")
    assert write_slice(spark.createDataFrame([(1, "ż", ["x"])], "id int, t string, l array<string>"), path)
    assert open(path, encoding="utf-8").read() == json.dumps([{"id": 1, "t": "ż", "l": ["x"]}], ensure_ascii=False, indent=2)
    assert [tuple(r) for r in records.read_array(spark, path, "id int, t string").collect()] == [(1, "ż")]
    with pytest.raises(ValueError):
        write_slice(spark.range(5), path, most=4)


class Source:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.calls = spark, folder, []
        folder.mkdir()

    def put(self, name, *ids):
        (self.folder / name).write_text("".join(json.dumps({"id": i}) + "\n" for i in ids))

    def start(self, root, cap, fail=None, progress=None, **more):
        stream = self.spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).json(str(self.folder))

        def answer(rows):
            got = [r.id for r in rows.collect()]
            if fail in got:
                raise RuntimeError("stopped here")
            self.calls += got
            return rows.select("id", F.concat(F.lit(f"{cap}:"), "id").alias("raw"))

        run = resume_run(self.spark, root, "id", SCHEMA, cap, **more)
        run.stream(stream, answer, progress=progress).awaitTermination()
        return run


def answers(run):
    return sorted((r.id, r.raw, r.max_tokens) for r in run.rows().collect())


def test_restarts_and_caps(spark, tmp_path):
    source, root = Source(spark, tmp_path / "in"), str(tmp_path / "run")
    source.put("a.json", "1", "2", "2", None)
    source.put("b.json", "3", "1")
    with pytest.raises(Exception, match="stopped here"):
        source.start(root, 512, fail="3")
    assert sorted(source.calls) == ["1", "2"]
    run = source.start(root, 512)  # goes on with what is missing
    assert sorted(source.calls) == ["1", "2", "3"] and answers(run) == [(i, f"512:{i}", 512) for i in "123"]
    source.put("c.json", "2", "4")
    again = source.start(root, 512)
    assert sorted(source.calls) == ["1", "2", "3", "4"] and again.info == run.info
    other = source.start(root, 1024)  # another cap: all anew, the old answers stay beside
    assert len(source.calls) == 8 and answers(other) == [(i, f"1024:{i}", 1024) for i in "1234"]
    assert other.info["superseded"] == {"folder": run.info["folder"], "suffix": ".cap512"} and len(answers(again)) == 4
    anew = source.start(root, 1024, fresh=True)
    assert len(source.calls) == 12 and anew.info["superseded"]["suffix"] == ".cap1024"
    wanted = spark.createDataFrame([("4", 0), ("2", 1), ("3", 2)], "id string, pos int")
    path = anew.finish(wanted)
    lines = [json.loads(line) for name in sorted(os.listdir(path)) if name.endswith(".json") for line in open(f"{path}/{name}")]
    assert [x["id"] for x in lines] == ["4", "2", "3"]
    assert anew.finish(wanted.unionByName(spark.createDataFrame([("9", 3)], "id string, pos int"))) is None


def test_rows_of_an_older_sink_are_taken_over(spark, tmp_path):
    source, root = Source(spark, tmp_path / "in"), str(tmp_path / "run")
    source.put("a.json", "1", "2", "3")
    lines = spark.createDataFrame([(0, '{"id":"1","raw":"old","max_tokens":512}'), (1, '{"id":"2","raw":"old","max_tokens":64}'), (2, '{"id":"3","ra')], "pos long, line string")
    done = records.load_completed(lines, "id", f"{SCHEMA}, max_tokens long", ("raw",), lambda: records.under_cap(512))
    run = source.start(root, 512, completed=done)
    assert sorted(source.calls) == ["2", "3"] and answers(run) == [("1", "old", 512), ("2", "512:2", 512), ("3", "512:3", 512)]
    assert source.start(root, 512, completed=done).info == run.info and len(source.calls) == 2
    assert answers(source.start(root, 512, fresh=True, completed=done))[0] == ("1", "512:1", 512)


def test_the_sink_is_not_read_by_a_batch(spark, tmp_path, monkeypatch):
    source, root = Source(spark, tmp_path / "in"), str(tmp_path / "run")
    source.put("a.json", "1", "2")
    source.start(root, None)
    source.put("b.json", "2", "5")
    for name in ("append_missing", "todo", "_held"):
        monkeypatch.setattr(resume, name, lambda *a: pytest.fail("the sink was read"))
    monkeypatch.setattr(resume.Run, "_read", lambda *a: pytest.fail("the sink was read"))
    source.start(root, None)
    assert sorted(source.calls) == ["1", "2", "5"]


def test_progress_by_listener(spark, tmp_path):
    source, root = Source(spark, tmp_path / "in"), str(tmp_path / "run")
    source.put("a.json", "1", "2", "1")
    source.put("b.json", "2", "3")
    listener = Progress(total=10, before=4)
    spark.streams.addListener(listener)
    try:
        source.start(root, 1, progress=listener)
        waited = time.time()
        while listener.produced < 3 and time.time() - waited < 20:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    done, left = listener.state()
    assert (done, listener.produced) == (7, 3) and left > 0
    assert Progress(5).state() == (0, None)
