"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with the reference of its language, the
sum of the histograms of all documents in that language, by Jensen-Shannon distance. A document goes if it fails the base
rules, or if it is long enough to judge and one of the two distances is beyond its threshold.

One pass over the texts makes a small row of counts for each document; those rows are written once in the shared folder
and serve both the references (a map-side combined sum) and the distances, so the text is neither shuffled nor read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, restricted, row_key, small_batches
from .textvec import LOWER, SPACE, Block, blocks, mix, shingle_hashes, span_hashes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Common words of each language, lower case.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by from he are this or an",
    "fr": "le la les de des du et un une en que qui est pour dans au aux pas ou avec",
    "de": "der die das und in den von zu mit ist des im für auf ein eine nicht auch es dem",
    "es": "el la los las de del que y en un una por con para se su es al no lo",
}
WORDS = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. A distance is between 0 (same distribution) and 1; fewer than ``min_words`` words are not judged by it.

    A histogram of n words lies at a distance of about 2 to 3 divided by the root of n from its own distribution by chance
    alone, so the words' threshold is ``word_noise`` divided by the root of n where that is larger.
    """

    min_total_words: int = 10
    max_repeat_percent: int = 20
    min_words: int = 40
    max_class_distance: float = 0.3
    max_word_distance: float = 0.24
    word_noise: float = 3.9


def _class_table() -> np.ndarray:
    """Class of each byte; bytes that continue a code point have none (-1)."""
    table = np.full(256, CLASSES.index("other"), np.int8)
    for name, chars in (("stop", b".,;:!?'\"()-"), ("symbol", SYMBOLS.encode()), ("space", b" \t\n\x0b\x0c\r"), ("digit", b"0123456789")):
        table[list(chars)] = CLASSES.index(name)
    table[97:123], table[65:91], table[128:] = CLASSES.index("lower"), CLASSES.index("upper"), CLASSES.index("beyond")
    table[0x80:0xC0] = -1
    return table


_CLASS = _class_table()
_LETTER = (_CLASS <= 1) & (_CLASS >= 0)
_LETTER[128:] = True


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(WORDS).encode(), np.uint8)
    ends = np.concatenate((np.flatnonzero(data == 32), [len(data)]))
    h = span_hashes(data, np.concatenate(([0], ends[:-1] + 1)), ends)
    order = np.argsort(h)
    return h[order], order


_WORD_HASH, _WORD_AT = _word_table()


def _by_text(kind: np.ndarray, text: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(text * width + kind, minlength=n * width).reshape(n, width)


#: Bytes that are counted at once, so that what is made of them does not grow with the text.
PIECE = 1 << 20


def _byte_counts(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the characters by class, and those in words."""
    classes, word_chars = np.zeros((block.n, len(CLASSES)), np.int64), np.zeros(block.n, np.int64)
    for at in range(0, len(block.data), PIECE):
        part = block.data[at : at + PIECE]
        text = np.repeat(np.arange(block.n), np.diff(np.clip(block.bounds, at, at + len(part))))
        kind = _CLASS[part]
        real = kind >= 0
        classes += _by_text(kind[real].astype(np.int64), text[real], block.n, len(CLASSES))
        word_chars += np.bincount(text[((part & 0xC0) != 0x80) & ~SPACE[part]], minlength=block.n)
    return classes, word_chars


def features(block: Block) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    data, n = block.data, block.n
    starts, ends, text = block.words()
    n_words = np.bincount(text, minlength=n)
    by_class, word_chars = _byte_counts(block)

    cuts = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate((block.bounds[:-1], cuts + 1)))
    line_end = np.minimum(np.concatenate((line_start[1:] - 1, [len(data)])), len(data))
    line_text = np.searchsorted(block.bounds, line_start, "right") - 1
    inner = line_text < n
    line_start, line_end, line_text = line_start[inner], line_end[inner], line_text[inner]
    # where the next line belongs to another text, no newline stands between
    last = np.concatenate((line_text[1:] != line_text[:-1], [True])) if len(line_text) else np.zeros(0, bool)
    text_end = block.bounds[1:][line_text[last]]
    # a text's last newline ends its last line; an empty text has no byte to look at
    closed = (text_end > line_start[last]) & (data[np.maximum(text_end - 1, 0)] == 10) if len(data) else np.zeros(len(text_end), bool)
    line_end[last] = text_end - closed
    has = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_text = line_start[has], line_end[has], line_text[has]
    keys = mix(span_hashes(data, line_start, line_end) + line_text.astype(np.uint64))
    firsts = np.unique(keys, return_index=True)[1]
    n_dup_lines = np.bincount(line_text, minlength=n) - np.bincount(line_text[firsts], minlength=n)

    grams, at = shingle_hashes(span_hashes(data, starts, ends), text, 5)
    grams = mix(grams + text[at].astype(np.uint64))
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    repeated = at[twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams] if len(twice) else at[:0]
    del grams, at
    cover = np.zeros(len(starts) + 6, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + 5, -1)
    n_repeat = np.bincount(text[np.cumsum(cover)[: len(starts)] > 0], minlength=n)

    a, b, letters_text = block.runs(_LETTER[data])
    h = span_hashes(LOWER[data], a, b)
    slot = np.minimum(np.searchsorted(_WORD_HASH, h), len(WORDS) - 1)
    word = np.where(_WORD_HASH[slot] == h, _WORD_AT[slot], len(WORDS))
    by_word = _by_text(word, letters_text, n, len(WORDS) + 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": by_class[:, CLASSES.index("symbol")], "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "class_counts": by_class, "word_counts": by_word,
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_counts array<long>, word_counts array<long>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, block in blocks(batches, "text"):
        f = features(block)
        columns = [part.column(i) for i in range(part.num_columns - 1)]
        for values in f.values():
            if values.ndim == 1:
                columns.append(pa.array(values.astype(np.int64)))
            else:
                offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(np.int64))))
        yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], *f])


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _shares(x: Column) -> Column:
    def of(total: Column) -> Column:
        return F.transform(x, lambda v: F.when(total > 0, v / total).otherwise(0.0))

    return F.element_at(F.transform(F.array(_total(x)), of), 1)


def _js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts from an array of shares; null where there are no counts."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def distance(total: Column) -> Column:
        terms = F.zip_with(counts, reference, lambda v, q: part(v / total, q) + part(q, v / total))
        return F.sqrt(F.greatest(F.lit(0.0), _total(terms) / 2))

    # through an array of one element the total is worked out once, not for each term
    return F.element_at(F.transform(F.array(_total(counts)), lambda t: F.when(t > 0, distance(t))), 1)


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep``, the counts, both distances, ``base_failed`` and ``kept``.

    Nulls: a null text is empty (no words, so it fails the base rules); rows with null language share a reference of
    their own; other columns may be null. Repeated rows and ties are judged alike, each on its own row. An empty table
    gives an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    columns = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    narrow = docs.select(*columns, F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    counted = materialise(narrow.mapInArrow(_count, f"{schema}, lang string, {COUNTS}"), "quality")

    def added(name: str, width: int) -> Column:
        return F.array(*(F.sum(F.col(name)[i]) for i in range(width))).alias(f"all_{name}")

    references = counted.groupBy("lang").agg(added("class_counts", len(CLASSES)), added("word_counts", len(WORDS) + 1))
    for name in ("all_class_counts", "all_word_counts"):
        references = references.withColumn(name, _shares(F.col(name)))
    references = materialise(references, "references")  # one row per language
    judged = counted.join(references, "lang").select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _js_distance(F.col("class_counts"), F.col("all_class_counts")).alias("class_distance"),
        _js_distance(F.col("word_counts"), F.col("all_word_counts")).alias("word_distance"),
    )
    base_failed = (F.col("n_words") < rules.min_total_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    word_limit = F.greatest(F.lit(rules.max_word_distance), rules.word_noise / F.sqrt("n_words"))
    far = (F.col("class_distance") > rules.max_class_distance) | (F.col("word_distance") > word_limit)
    diverges = (F.col("n_words") >= rules.min_words) & F.coalesce(far, F.lit(False))
    return judged.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~diverges)


def passing(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, whole, that ``quality_rules`` keeps."""
    keyed = docs.withColumn("__row", row_key(id_col, lang_col, text_col))
    judged = quality_rules(keyed, rules, text_col, lang_col, keep=("__row",))
    gone = materialise(judged.where("not kept").select("__row").distinct(), "rejected")
    return restricted(keyed, gone, "__row", "left_anti").drop("__row")
