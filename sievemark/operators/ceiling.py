"""How much of the labels a text holds at all: an upper bound of recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from ..functions.columns import rounded, texts

#: Spellings that a dictionary may have; every task holds all of them.
MOST_SPELLINGS = 1_000_000


class _Folds(dict):
    """Letters by one form for all their cases, where that form is one letter."""

    def __missing__(self, point: int) -> int:
        upper = chr(point).upper()
        lower = (upper if len(upper) == 1 else chr(point)).lower()
        self[point] = ord(lower) if len(lower) == 1 else point
        return self[point]


_FOLDS = _Folds()


def folded(text: str) -> str:
    """``text`` without case, at the same length."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole(text: str, start: int, end: int) -> bool:
    """Whether no letter, digit or underscore lies beside this part of the text."""
    return not (start and _word(text[start - 1])) and not (end < len(text) and _word(text[end]))


def holds(text: str, term: str) -> bool:
    """Whether a folded text holds a folded term as whole words."""
    at = text.find(term)
    while at >= 0 and not whole(text, at, at + len(term)):
        at = text.find(term, at + 1)
    return at >= 0


class Spellings:
    """All spellings of all canonical terms in one automaton: a text is read once, however many there are.

    A canonical term is a spelling of itself.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]) -> None:
        import ahocorasick

        terms: dict[str, set[str]] = {}
        for alias, canonical in pairs:
            for spelling in (alias, canonical):
                terms.setdefault(folded(spelling), set()).add(canonical)
        self.canonical = {c for _, c in pairs}
        self.empty = terms.pop("", set())
        self.automaton = ahocorasick.Automaton()
        for spelling, names in terms.items():
            self.automaton.add_word(spelling, (len(spelling), names))
        if terms:
            self.automaton.make_automaton()

    def found(self, text: str) -> set[str]:
        """Canonical terms that a folded text holds as whole words."""
        out = set(self.empty) if self.empty and holds(text, "") else set()
        for end, (length, names) in self.automaton.iter(text) if len(self.automaton) else ():
            if not names <= out and whole(text, end + 1 - length, end + 1):
                out |= names
        return out

    def present(self, text: str, found: set[str], term: str) -> bool:
        """Whether a label is in the text: by any spelling, or as it is where the dictionary does not know it."""
        return term in found if term in self.canonical else holds(text, folded(term))


def spellings(aliases: DataFrame) -> Callable[[], Spellings]:
    """The automaton of ``aliases (alias, canonical)``, for tasks, which build it once each."""
    rows = aliases.select("alias", "canonical").where("alias is not null and canonical is not null").distinct().limit(MOST_SPELLINGS + 1).toArrow()
    if rows.num_rows > MOST_SPELLINGS:
        raise ValueError(f"more than {MOST_SPELLINGS} spellings")
    pairs = list(zip(rows["alias"].to_pylist(), rows["canonical"].to_pylist()))
    shared = aliases.sparkSession.sparkContext.broadcast(pairs)
    return lambda: Spellings(shared.value)


def found_terms(rows: DataFrame, aliases: DataFrame, text: str = "prose", into: str = "found") -> DataFrame:
    """``rows`` with the canonical terms of their text, sorted; a null text has none."""
    made = spellings(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made()
        for b in pieces(batches):
            values = pa.array([sorted(known.found(folded(t.as_py() or ""))) for t in b.column("__text")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], values], names=[*b.schema.names[:-1], into])

    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != into), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, `{into}` array<string>")


def ceilings(records: DataFrame, aliases: DataFrame, fields: Sequence[str] = ("tech_expected", "tech_optional"), id_col: str = "offer_id") -> DataFrame:
    """Per field: terms, terms found in the record's prose, their share, records with terms and those with none found.

    Each record is read once where it lies; no text is shuffled, and rows that share an id count each. A term that is no
    canonical name is searched as it is. A null prose holds nothing.
    """
    made = spellings(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made()
        for b in pieces(batches):
            out = []
            for text, *lists in zip(*(c.to_pylist() for c in b.columns)):
                if not any(lists):
                    continue
                text = folded(text or "")
                found = known.found(text)
                out += [(f, len(terms), sum(known.present(text, found, t) for t in terms)) for f, terms in zip(fields, lists) if terms]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["field", "terms", "present"])

    labels = [texts(F.col("gold")[f]).alias(f"__{i}") for i, f in enumerate(fields)]
    per = records.select(F.col("prose").cast("string"), *labels).mapInArrow(run, "field string, terms long, present long")
    sums = per.groupBy("field").agg(
        F.sum("terms").alias("terms"), F.sum("present").alias("present"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("present") == 0).alias("unanswerable")
    )
    names = records.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    out = names.join(sums, "field", "left").na.fill(0, ["terms", "present", "records", "unanswerable"])
    share = lambda a, b: rounded(F.try_divide(F.col(a).cast("double"), F.col(b)))
    return out.withColumns({"share": share("present", "terms"), "unanswerable_share": share("unanswerable", "records")})


def achieved(ceiling: DataFrame, best: DataFrame) -> DataFrame:
    """Best recall as a share of what the texts hold; null where they hold nothing."""
    return ceiling.join(best, "field", "left").withColumn("achieved", F.when(F.col("share") > 0, rounded(F.col("best_recall") / F.col("share"))))
