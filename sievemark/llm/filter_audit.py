"""What each of five filters removes, under every order in which they can be applied.

The table is read once: each document becomes a mask of the filters that it fails, and a part (source) becomes at most 32
cells ``(mask, documents, good, toxic)``, summed on the map side. All orders follow from the cells. They are visited by single
swaps of neighbours (plain changes, so 120 orders are 119 swaps): a swap leaves what is kept after all other steps as it
was, so only the two steps that changed places are worked out anew. The sums for the Shapley values grow along the walk. A
batch of parts is walked at once, as columns of numpy arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, materialise

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
_SPACES = b" \t\n\x0b\x0c\r"
#: Words are counted in pieces of about so many bytes, so that a long text needs memory for its distinct words alone.
PIECE = 1 << 20


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words of a text."""
    if len(text) <= 2 * PIECE:
        words = text.split()  # of bytes: exactly the class [\x20\x09-\x0D]
        return len(words), len(set(words))
    known, n, at = set(), 0, 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        words = text[at:end].split()
        n += len(words)
        known.update(words)
        at = end
    return n, len(known)


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D, which look at the text alone."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    marks = len(text.translate(None, _MARKS)) < len(text)
    return (words < 200) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | marks << 3


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [(x.as_py() or "").encode() for x in b.column(2)]
        masks = pa.array([own_failures(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(part, mask, n, good, toxic)``: the documents of each part by the filters that they fail."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(docs.sparkSession):
        masks = materialise(rows.mapInArrow(_masked, f"doc_id {id_type}, part string, mask int, digest binary"), "filter-masks")
    # the copy with the smallest id is met by text and id together, so no join has a text's copies as one key
    firsts = masks.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    known = masks.where("doc_id is not null").join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = known.select("part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), "good", "toxic")
    nameless = masks.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return known.unionByName(nameless).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places whose neighbours change in turn, so that every order of ``n`` things is met once: the last thing walks through
    the orders of the others, and after each of its walks they make one swap of their own."""  # noqa: D209
    if n < 2:
        return
    down = True
    for own in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if own is not None:
            yield own + 1 if down else own
        down = not down


class Walk:
    """Counts per step of one order for many parts; ``swap`` goes on to the next order."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.filters = cells, len(FILTERS)  # cells[part, count, mask]
        masks = np.arange(cells.shape[2])
        self.failing = [cells[:, 0, (masks >> f & 1) == 1].sum(1) for f in range(self.filters)]
        self.lone = [cells[:, 0, 1 << f] for f in range(self.filters)]
        self.order, self._masks = list(range(self.filters)), masks
        # kept[k]: documents, good and toxic ones that pass the first k filters
        self.kept = [self._passing(k) for k in range(self.filters + 1)]
        self.removed = [self.kept[k] - self.kept[k + 1] for k in range(self.filters)]

    def _passing(self, k: int) -> np.ndarray:
        used = sum(1 << f for f in self.order[:k])
        return self.cells[:, :, (self._masks & used) == 0].sum(2)

    def swap(self, k: int) -> None:
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.kept[k + 1] = self._passing(k + 1)
        for step in (k, k + 1):
            self.removed[step] = self.kept[step] - self.kept[step + 1]


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "filter_order", "step", *COUNTS]
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            cells = np.zeros((b.num_rows, 3, 1 << len(FILTERS)), np.int64)
            for p, found in enumerate(b.column(1).to_pylist()):
                for c in found:
                    cells[p, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            walk, visited, shapley = Walk(cells), [], np.zeros((len(FILTERS), b.num_rows), np.int64)
            for k in [None, *swaps(len(FILTERS))]:
                if k is not None:
                    walk.swap(k)
                for step, f in enumerate(walk.order):
                    shapley[f] += walk.removed[step][:, 0]
                visited.append((list(walk.order), list(walk.kept), list(walk.removed)))
            parts, orders, steps, columns = [], [], [], [[] for _ in COUNTS]
            for order, kept, removed in visited:
                spelt = "".join(FILTERS[f] for f in order)
                for step, f in enumerate(order):
                    gone = removed[step]
                    counts = kept[step + 1][:, 0], gone[:, 0], walk.failing[f] - gone[:, 0], walk.lone[f], gone[:, 1], gone[:, 2], shapley[f]
                    parts.append(b.column(0))
                    orders += [spelt] * b.num_rows
                    steps.append(np.full(b.num_rows, step + 1, np.int32))
                    for column, values in zip(columns, counts):
                        column.append(values)
            part = pa.concat_arrays(parts)
            yield pa.RecordBatch.from_arrays([part, pa.array(orders), pa.array(np.concatenate(steps)), *(pa.array(np.concatenate(c)) for c in columns)], names=names)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each part, order of the filters and step: ``(part, filter_order, step)`` and the counts of ``COUNTS``.

    The filters fail a text of under 200 words (A), with fewer distinct words than half of its words (B), with over 2 % of
    capitals A-Z (C), with one of ``#$%&*|`` (D), or equal to the text of a smaller id anywhere in the table (E). Null
    texts are empty, the null part is the empty string. A null id is smaller than none and has none below it; rows of one
    id are no copies of each other and count each. Several labels of an id count as one that has the flags of all; other
    labels are ignored, as are other columns. An empty table has no parts and gives no rows.
    """
    cells = failure_cells(docs, labels, id_col, part_col, text_col)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return by_part.mapInArrow(_walked, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
