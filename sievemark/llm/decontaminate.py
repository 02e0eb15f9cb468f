"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity with it, so MinHash would miss it. Items are therefore
partitioned by their number of shingles into classes [B, 2B), and for each class a document is seen as windows of three
blocks of B shingles, one window from every block on: an item that occurs in one piece lies within some window, of at most
three times its size, and shares a MinHash value with it almost surely (48 permutations: an exact copy is missed with
probability (2/3)^48). A pair that shares a value is then verified by exact containment of the item's shingles in the whole
document. Items of fewer than eight shingles are searched by each of their shingles, with no chance of a miss, and items of
fewer words than a shingle has as one sequence.

Documents are scanned in place: no text is shuffled. What goes to the tasks is the index of a chunk of items, whose size is
bounded by ``chunk_chars``; more items make more chunks, and each chunk is a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, restricted, row_key, small_batches
from .textvec import LOWER, Block, blocks, shingle_hashes, span_hashes

PERMUTATIONS = 48
SHORT = 8
_RNG = np.random.default_rng(77003)
_FACTORS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(44)

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z lower-cased) and their texts."""
    starts, ends, text = block.runs(_ALNUM[block.data])
    return span_hashes(LOWER[block.data], starts, ends), text


def _keys(minima: np.ndarray, j: int) -> np.ndarray:
    return minima * _SPREAD + _SALTS[j]


@dataclass
class ItemIndex:
    """The items of a chunk: their shingles, one after the other, and for each class the sorted MinHash keys with their items.

    ``brief`` has, for each number of words below ``k``, the items of so many words as (hash, item).
    """

    ids: list
    shingles: np.ndarray
    edges: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: tuple[np.ndarray, np.ndarray]
    brief: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: pa.Array, k: int) -> ItemIndex:
        block = Block(texts)
        words, of_word = word_hashes(block)
        h, at = shingle_hashes(words, of_word, k)
        text = of_word[at]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[fresh], text[fresh]
        size = np.bincount(text, minlength=block.n)
        edges = np.concatenate(([0], np.cumsum(size)))
        few = size[text] < SHORT
        classes: dict = {}
        long = np.flatnonzero(size >= SHORT)
        if len(long):
            own, begins = h[~few], np.concatenate(([0], np.cumsum(size[long])[:-1]))
            keys = np.stack([_keys(np.minimum.reduceat(own * _FACTORS[j], begins), j) for j in range(PERMUTATIONS)])
            base = 1 << np.floor(np.log2(size[long])).astype(np.int64)
            for b in np.unique(base):
                mine = base == b
                found = keys[:, mine].ravel(), np.tile(long[mine], PERMUTATIONS)
                classes[int(b)] = (*cls._sorted(*found), cls._filter(found[0]))
        n_words, brief = np.bincount(of_word, minlength=block.n), {}
        for n in range(1, k):
            g, at = shingle_hashes(words, of_word, n)
            whole = n_words[of_word[at]] == n
            if whole.any():
                brief[n] = cls._sorted(g[whole], of_word[at][whole])
        return cls(ids, h, edges, classes, cls._sorted(h[few], text[few]), brief)

    @staticmethod
    def _sorted(keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], items[order]

    @staticmethod
    def _filter(keys: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[(keys >> _BITS).astype(np.int64)] = True
        return bits

    def candidates(self, h: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Pairs (text, item) that share a key, as rows."""
        found: list[np.ndarray] = []
        if len(self.short[0]) and len(h):
            found.append(_matches(h, text, *self.short))
        if self.classes and len(h):
            first = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1))
            local = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate((first, [len(h)]))))
            plans, size, starts, of = [], 0, None, text
            for b in self.classes:  # each class is made of whole blocks of the one before
                at = local if size == 0 else np.arange(len(of)) - np.repeat(f := np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1)), np.diff(np.concatenate((f, [len(of)]))))
                starts = np.flatnonzero(at % (b // max(size, 1)) == 0)
                of, size = of[starts], b
                two, three = of[1:] == of[:-1], of[2:] == of[:-2]
                plans.append((b, starts, of, two, three))
            for j in range(PERMUTATIONS):
                minima = h * _FACTORS[j]
                for b, starts, of, two, three in plans:
                    minima = np.minimum.reduceat(minima, starts)
                    window = minima.copy()
                    window[:-1] = np.where(two, np.minimum(window[:-1], minima[1:]), window[:-1])
                    window[:-2] = np.where(three, np.minimum(window[:-2], minima[2:]), window[:-2])
                    keys, items, bits = self.classes[b]
                    key = _keys(window, j)
                    hit = np.flatnonzero(bits[(key >> _BITS).astype(np.int64)])
                    if len(hit):
                        found.append(_matches(key[hit], of[hit], keys, items))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _matches(values: np.ndarray, text: np.ndarray, keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, "right")
    n = high - low
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.stack((np.repeat(text, n), items[at]), 1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _search(index: ItemIndex, k: int, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in blocks(batches, "text"):
            words, of_word = word_hashes(block)
            h, at = shingle_hashes(words, of_word, k)
            text = of_word[at]
            rows, kept = [], None
            for n, brief in index.brief.items():
                g, at = shingle_hashes(words, of_word, n)
                rows += [(int(t), index.ids[i], 1, 1) for t, i in _matches(g, of_word[at], *brief)]
            for t, i in index.candidates(h, text):
                if kept is None or kept[0] != t:
                    kept = (t, np.unique(h[np.searchsorted(text, t) : np.searchsorted(text, t, "right")]))
                wanted = index.shingles[index.edges[i] : index.edges[i + 1]]
                at = np.minimum(np.searchsorted(kept[1], wanted), len(kept[1]) - 1)
                n = int((kept[1][at] == wanted).sum())
                if n >= threshold * len(wanted) - 1e-9:
                    rows.append((int(t), index.ids[i], len(wanted), n))
            if rows:
                take = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    names=["id", "item_id", "n_shingles", "n_found"],
                )

    return scan


def contained_items(
    docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", chunk_chars: int = 8_000_000,
) -> DataFrame:
    """Rows ``(id, item_id, n_shingles, n_found)``: an item of which ``threshold`` of the shingles are in the document.

    Null or empty texts, on either side, have no shingles and match nothing. An item of fewer than ``k`` words is one shingle,
    the sequence of them. Null ids are returned as null. Repeated documents and repeated items each give their rows. Other columns are ignored,
    whatever their names; an empty table on either side gives an empty result. Long texts are searched whole.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item_id long, n_shingles long, n_found long"
    wanted = items.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = math.ceil(chars / chunk_chars)
    out = spark.createDataFrame([], schema)
    for c in range(chunks):
        chunk = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == c).toArrow()
        if chunk.num_rows:  # at most some chunk_chars of text
            index = ItemIndex.of(chunk.column("item").to_pylist(), chunk.column("text").combine_chunks(), k)
            out = out.unionByName(texts.mapInArrow(_search(index, k, threshold), schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Each row is judged by its own text."""
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    hits = contained_items(keyed.select("__row", F.col(text_col).alias("text")), items, id_col="__row", text_col="text", **options)
    hits = materialise(hits.select(F.col("id").alias("__row")).distinct(), "contaminated")
    return restricted(keyed, hits, "__row", "left_anti").drop("__row")
