"""Token ids in training order, as binary shards of fixed stride.

Texts become token ids, an end-of-text id after each, packed into sequences of ``length`` ids within each input partition.
The sequences are numbered over all partitions, and a keyed Feistel permutation with cycle-walking gives each number its
slot, so that slots are a permutation of 0..n-1 that anyone with the key can compute both ways. Shard s holds the slots from
s * per_shard on, in order: sequence ``slot`` lies at byte ``(slot % per_shard) * stride`` of shard ``slot // per_shard``,
so a reader goes through files in sequence and can resume at any step.

Ids are 16-bit little-endian. Spark's text writer writes the shards, with two newlines after each record, so that a shard is
rows of ``length + 1`` 16-bit numbers: any file system that Spark can write will do, and a lost task's shards are written
anew. Tasks write whole ranges of shards. The writer sorts its rows by shard, which keeps no other order once it spills; so a
row of the writer is a whole shard, put together from the sorted slots before. The index has a checksum of each sequence, which
``shard_rows`` holds against what it reads.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import delete_path, discard, materialise, scratch_path, session_settings, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of 0..n-1: a balanced network over the next even number of bits, walked until it is in range."""

    n: int
    key: str
    rounds: int = 6

    @property
    def half(self) -> int:
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _mixed(self, right: np.ndarray, r: int) -> np.ndarray:
        salt = int.from_bytes(hashlib.sha256(f"{self.key}/{r}".encode()).digest()[:8], "little")
        h = (right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, rounds: range) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        if rounds.step < 0:
            for r in rounds:
                left, right = right ^ self._mixed(left, r), left
        else:
            for r in rounds:
                left, right = right, left ^ self._mixed(right, r)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, rounds: range) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), rounds)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], rounds)
        return out.astype(np.int64)

    def slot(self, number: np.ndarray) -> np.ndarray:
        return self._walk(number, range(self.rounds))

    def number(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(self.rounds - 1, -1, -1))


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary, read by the driver: one base64 token and its rank per line. Its size is fixed (some 50,000 entries)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Texts are encoded in parts of about so many characters.
PART = 100_000


def encoder(ranks: dict[bytes, int]) -> Callable[[str], np.ndarray]:
    """Ids of a text of any length.

    No match of the pattern goes from a letter, digit or mark on to a blank or newline, so a text can be cut there without
    changing its ids. A run without such a place that is longer than ``2 * PART`` is too deep for the tokenizer's own
    matcher; its pre-tokens are found by another one and merged one by one.
    """
    import regex
    import tiktoken

    whole = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    single = whole._core_bpe.encode_single_piece
    ids = lambda text: whole.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
    cut = regex.compile(r"(?<=[!-~\p{L}\p{N}])[ \n]")
    pieces = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def encode(text: str) -> np.ndarray:
        if len(text) <= 2 * PART:
            return ids(text)
        out, at = [], 0
        while at < len(text):
            found = cut.search(text, at + PART) if len(text) - at > 2 * PART else None
            end = found.start() if found else len(text)
            if end - at <= 2 * PART:
                out.append(ids(text[at:end]))
            else:
                out += [np.array(single(m[0].encode()), np.uint16) for m in pieces.finditer(text[at:end])]
            at = end
        return np.concatenate(out)

    return encode


SEQUENCES = "part int, number long, n_tokens long, n_docs long, first_id {id}, checksum long, ids binary"


def _pack(ranks, length: int, id_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        part, number, n_docs, first = TaskContext.get().partitionId(), 0, 0, None
        open_ids, n_open, rows = [], 0, []

        def row(n_tokens: int, sequence: bytes) -> tuple:
            return part, number, n_tokens, n_docs, first, zlib.crc32(sequence), sequence

        def batch() -> pa.RecordBatch:
            names = ["part", "number", "n_tokens", "n_docs", "first_id", "checksum", "ids"]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), id_type, pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for got in batches:
            for doc, text in zip(got.column(0).to_pylist(), got.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint16(END))
                first = doc if not n_docs else first
                n_docs += 1
                while n_open + len(ids) >= length:
                    cut = length - n_open
                    rows.append(row(length, np.concatenate([*open_ids, ids[:cut]]).tobytes()))
                    ids, open_ids, n_open, number = ids[cut:], [], 0, number + 1
                    n_docs, first = (1, doc) if len(ids) else (0, None)
                    if len(rows) >= 64:
                        yield batch()
                        rows = []
                if len(ids):
                    open_ids.append(ids)
                    n_open += len(ids)
        if n_open:
            rows.append(row(n_open, np.concatenate([*open_ids, np.full(length - n_open, END, np.uint16)]).tobytes()))
        if rows:
            yield batch()

    return pack


def _placed(permutation: Feistel):
    """Slots of the numbered sequences; records travel compressed."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            slots = permutation.slot(b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([squeeze(x.as_buffer()) for x in b.column(1)], pa.binary())], names=["slot", "packed"])

    return place


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards of rows in the order of their slots: one row for each shard, without the last newline."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    shard, records = None, []

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([b"\n\n".join(records) + b"\n"], pa.binary())], names=["shard", "content"])

    for b in batches:
        for at, packed in zip(b.column(0).to_pylist(), b.column(1)):
            if at != shard and records:
                yield whole()
                records = []
            shard = at
            records.append(expand(packed.as_buffer()))
    if records:
        yield whole()


@dataclass(frozen=True)
class Shards:
    path: str
    length: int
    per_shard: int
    index: DataFrame

    @property
    def stride(self) -> int:
        return 2 * self.length + 2

    def records(self, spark: SparkSession, start: int = 0) -> DataFrame:
        """``(slot, shard, at, ids)`` read back from the files, from slot ``start`` on; ``at`` is the record's first byte in
        its shard. Shards before that slot are not opened, so a run that stopped goes on where it was."""  # noqa: D209
        files = spark.read.format("binaryFile").option("basePath", self.path).load(self.path)
        files = files.where(F.col("shard") >= start // self.per_shard).select(F.col("shard").cast("long").alias("shard"), "content")
        # the file is cut in the projection over the row numbers: inside a lambda each record would copy the whole file
        rows = files.select("shard", "content", F.explode(F.sequence(F.lit(0), (F.octet_length("content") / self.stride).cast("int") - 1)).alias("row"))
        slot = F.col("shard") * self.per_shard + F.col("row")
        rows = rows.where(slot >= start)
        ids = F.substr("content", F.col("row") * self.stride + 1, F.lit(2 * self.length))
        return rows.select(slot.alias("slot"), "shard", (F.col("row") * self.stride).cast("long").alias("at"), ids.alias("ids"))


def write_shards(
    docs: DataFrame, path: str | None = None, length: int = 8192, per_shard: int = 1024, key: str = "training-order",
    tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
) -> Shards:
    """Write the token shards of ``docs``; the index has ``(slot, n_tokens, n_docs, first_id, checksum)`` of each sequence.

    A task holds one shard of ``per_shard`` records at a time (16 MB as it is), which must stay below 2 GB.

    A null or empty text is an end-of-text id alone. Null ids are kept as they are; repeated rows are written each. The
    last sequence of every input partition is filled up with end-of-text ids, ``n_tokens`` says how many are its own. A
    text of any length runs over as many sequences as it needs. An empty table writes nothing. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    ranks = spark.sparkContext.broadcast(read_ranks(tokenizer))
    from pyspark.sql.pandas.types import to_arrow_type

    packed = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_pack(ranks, length, to_arrow_type(id_type)), SEQUENCES.format(id=id_type.simpleString()))
    folder = scratch_path(spark, "sequences")
    packed.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 9).parquet(folder)
    sequences = spark.read.schema(packed.schema).parquet(folder)

    parts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per input partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.withColumn("before", before), "sequence-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    permutation = Feistel(total, key)
    numbered = sequences.join(parts.select("part", "before"), "part").withColumn("number", F.col("before") + F.col("number"))

    path = path or scratch_path(spark, "shards")
    placed = numbered.select("number", "ids").mapInArrow(_placed(permutation), "slot long, packed binary")
    shards = max(1, -(-total // per_shard))
    ranges = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    dealt = placed.repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("slot")
    whole = dealt.select("shard", "packed").mapInArrow(_opened, "shard long, content binary")
    lines = whole.select("shard", F.col("content").cast("string").alias("value"))
    with session_settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        lines.write.option("lineSep", "\n").partitionBy("shard").text(path)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(permutation.slot(b.column(0).to_numpy())), *b.columns[1:]], names=["slot", *b.schema.names[1:]])

    columns = f"slot long, n_tokens long, n_docs long, first_id {id_type.simpleString()}, checksum long"
    index = numbered.select("number", "n_tokens", "n_docs", "first_id", "checksum").mapInArrow(slots, columns)
    index = materialise(index, "sequence-index")
    delete_path(spark, folder)
    discard(parts)
    return Shards(path, length, per_shard, index)


def shard_rows(spark: SparkSession, shards: Shards) -> DataFrame:
    """One row per sequence, read back from the shards; a record that is not the one of its slot fails the job by name."""
    read = shards.records(spark).select("slot", "shard", "at", F.sha2("ids", 256).alias("ids_sha256"), F.crc32("ids").alias("__read"))
    rows = shards.index.join(read, "slot")
    wrong = F.raise_error(F.concat(F.lit("another record lies at slot "), F.col("slot").cast("string")))
    digest = F.when(F.col("__read") == F.col("checksum"), F.col("ids_sha256")).otherwise(wrong.cast("string"))
    return rows.select("slot", "n_tokens", "n_docs", "first_id", "shard", "at", digest.alias("ids_sha256"))
