"""Alignment of two tokenizers over the same texts, and how often their tokens meet in the whole corpus.

Both token sequences of a text are cut into elementary intervals: the union of both arrays of token ends. Each interval lies
in one token of either side, found by binary search, and two tokens overlap in one interval at most, so intervals are the
links. Ends that both sides share close a group.

A text is encoded once; a row keeps its counts, and its linked id pairs with their numbers. These are summed over the corpus
with partial sums in each task. The counts then go back to the rows in two ways: the most frequent pairs, ``FREQUENT`` of
them at most, are sent to all tasks and answer nearly all links there; the other pairs, none of which is frequent, are
joined by pair. So neither a pair that every text has nor a large number of different pairs is too much for one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, materialise
from .pieces import Codec, Vocabulary, flattened, lists, read_model, slices, spelling
from .token_shards import encoder

#: Pairs sent to all tasks at most: 17 bytes each.
FREQUENT = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_byte_vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks of the mergeable tokens, and the bytes of every id, of a byte-level BPE file, read on the driver.

    Only files whose merges stand in the order of their ids can be read, as ids then serve as ranks; others are refused.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, letters = whole["model"], byte_letters()
    splits = whole["pre_tokenizer"]
    if (splits["type"], splits["use_regex"], splits["add_prefix_space"], whole["normalizer"]) != ("ByteLevel", True, False, None):
        raise ValueError(f"{path}: only byte-level vocabularies with the usual pre-tokens can be read")
    special = {t["content"] for t in whole["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) + 256 != len(model["vocab"]) - len(special & set(model["vocab"])):
        raise ValueError(f"{path}: merges must stand in the order of their ids")
    spelt = [b""] * len(model["vocab"])
    for token, i in model["vocab"].items():
        spelt[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    return {spelt[i]: i for t, i in model["vocab"].items() if t not in special}, spelt


@dataclass(frozen=True)
class Alignment:
    """Tokens of one text by both tokenizers, as arrays; all are empty where the tokens' bytes are not the text's."""

    a: np.ndarray
    b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray
    links: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups_a[-1]) + 1 if len(self.a) else 0

    def group_sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.groups_a, minlength=self.n_groups), np.bincount(self.groups_b, minlength=self.n_groups)


def align(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Groups and links of two token sequences over the same bytes; ``links`` has the two token numbers of each interval."""
    ended = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 0, bool)
    ended[ends_a] = ended[ends_b] = True
    ends = np.flatnonzero(ended)  # the union of both, as np.union1d gives it, without its sort
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    shared = ends[(ends_a[own_a] == ends) & (ends_b[own_b] == ends)]
    return Alignment(a, b, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), np.stack([own_a, own_b]))


class Pair:
    """Both encoders of one worker."""

    def __init__(self, ranks: dict[bytes, int], spelt: list[bytes], vocabulary: Vocabulary) -> None:
        self.encode_a, self.codec = encoder(ranks), Codec(vocabulary)
        self.tokens = flattened(spelt)
        self.lengths = self.tokens[2]
        self.most = max(len(spelt), len(vocabulary.pieces))
        self.digits = flattened([f"{i}{after}".encode() for after in ",|;" for i in range(self.most)])

    def of(self, text: str | None) -> Alignment:
        none = np.zeros(0, np.int64)
        empty = Alignment(none, none, none, none, np.zeros((2, 0), np.int64))
        if not text:
            return empty
        target = f" {text}".encode()
        a, b = self.encode_a(f" {text}").astype(np.int64), self.codec.encode(text).astype(np.int64)
        if spelling(*self.tokens, a) != target or self.codec.spelling(b) != target:
            return empty
        return align(a, b, np.cumsum(self.lengths[a]), np.cumsum(self.codec.lengths[b]))

    def groups_text(self, x: Alignment) -> bytes:
        """``a1,a2|b1;a3|b2,b3``"""
        n_a, n_b = x.group_sizes()
        before_a, before_b = np.cumsum(n_a), np.cumsum(n_b)
        ids = np.zeros(len(x.a) + len(x.b), np.int64)
        ids[np.arange(len(x.a)) + (before_b - n_b)[x.groups_a]] = x.a
        ids[np.arange(len(x.b)) + before_a[x.groups_b]] = x.b
        ids[before_a + before_b - n_b - 1] += self.most  # the last A of a group
        ids[before_a + before_b - 1] += 2 * self.most  # its last B
        return spelling(*self.digits, ids)[:-1]


#: The encoders of this worker, with the broadcast value that they were made of.
_pairs: list[tuple] = []


def _pair(shared) -> Pair:
    if not _pairs or _pairs[0][0] is not shared.value:
        _pairs[:] = [(shared.value, Pair(*shared.value))]
    return _pairs[0][1]


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_products")


def _aligned(shared, size: int):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = _pair(shared), TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in slices(whole, 1)):
            counts, digests, keys, times = [], [], [], []
            for text in b.column(1):
                x = pair.of(text.as_py())
                n_a, n_b = x.group_sizes()
                counts.append((len(x.a), len(x.b), x.n_groups, x.links.shape[1], int((n_a * n_b).sum())))
                digests.append(hashlib.sha256(pair.groups_text(x)).hexdigest() if len(x.a) else "")
                key, n = np.unique(x.a[x.links[0]] * size + x.b[x.links[1]], return_counts=True)
                keys.append(key)
                times.append(n.astype(np.int32))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [rows, b.column(0), *columns, pa.array(digests), lists(keys, np.int64), lists(times)], names=["row", "id", *COUNTS, "groups_sha256", "pairs", "times"]
            )

    return aligned


def _looked_up(frequent, rest: bool):
    """Sums of a row's links over the frequent pairs; with ``rest``, its other pairs instead."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, best = frequent.value
        for b in batches:
            pairs, times = b.column("pairs"), b.column("times")
            key, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            sizes = np.diff(pairs.offsets.to_numpy())
            own = np.repeat(np.arange(b.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            if rest:
                rows = b.column("row").to_numpy()[own[~hit]]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(key[~hit]), pa.array(n[~hit])], names=["row", "pair", "n"])
                continue
            at, n, own = at[hit], n[hit], own[hit]
            total, top = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, own, n * totals[at])
            np.add.at(top, own, n * best[at])
            kept = [b.column(c) for c in ("row", "id", *COUNTS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(top)], names=["row", "id", *COUNTS, "groups_sha256", "count_sum", "n_best"])

    return looked_up


def align_tokenizers(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_products, groups_sha256, count_sum, n_best)`` of each row.

    A encodes a space and the text, B the text, to which it adds that space itself. Rows whose text is null or empty, or
    whose tokens by either side do not spell space and text (a text that holds the space mark of B), have no tokens: zeros
    and an empty digest. ``n_products`` is the number of id pairs that the groups hold, every A token with every B token of
    its group. ``count_sum`` adds, over a row's links, how many links of the corpus join the same two ids; ``n_best`` counts
    the links whose ids are joined as often as any A id is with that B id. Null ids are kept; repeated rows count each and
    each get their result; other columns are ignored; an empty table gives an empty result. The vocabularies are read on
    the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    ranks, spelt = read_byte_vocabulary(byte_vocabulary)
    vocabulary = read_model(piece_model)
    shared, size = spark.sparkContext.broadcast((ranks, spelt, vocabulary)), len(vocabulary.pieces)
    id_type = docs.schema[id_col].dataType.simpleString()
    own = f"row long, id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
    with arrow_batches(spark):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        aligned = materialise(rows.mapInArrow(_aligned(shared, size), f"{own}, pairs array<long>, times array<int>"), "aligned")

    found = aligned.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    counts = materialise(found.groupBy("pair").agg(F.sum("n").alias("total")), "pair-counts")
    b_id = F.pmod("pair", F.lit(size))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))  # at most one row for each id of B
    marked = counts.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))

    # the lowest power of two from which on there are few enough pairs; 63 rows at most
    power = F.floor(F.log2("total")).cast("int")
    least, known = 63, 0
    for p, n in sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True):
        known += n
        if known > frequent:
            break
        least = p
    few = marked.where(power >= least).orderBy("pair").toArrow()
    few = tuple(np.concatenate([np.zeros(0, kind), few.column(c).to_numpy()]).astype(kind) for c, kind in (("pair", np.int64), ("total", np.int64), ("best", bool)))
    sent = spark.sparkContext.broadcast(few)

    sums = aligned.mapInArrow(_looked_up(sent, False), f"{own}, count_sum long, n_best long")
    if known > frequent:
        rest = aligned.select("row", "pairs", "times").mapInArrow(_looked_up(sent, True), "row long, pair long, n long")
        rare = rest.join(marked.where(power < least), "pair").groupBy("row")
        rare = rare.agg(F.sum(F.col("n") * F.col("total")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("rare_best"))
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        sums = sums.join(rare, "row", "left").select("row", "id", *COUNTS, "groups_sha256", more("count_sum", "rare_sum"), more("n_best", "rare_best"))
    return sums.drop("row")
