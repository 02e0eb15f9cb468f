"""Encoding and decoding with a SentencePiece BPE vocabulary.

BPE joins the best-scoring neighbours first, but the same ids follow from left to right. Every prefix of a word has one
encoding, so it has one last token. A piece that ends at a place is that token exactly if it is *compatible* with the last
token of the prefix before it, that is, if the pair's own text is encoded as the pair. One run of an automaton over the word
lists all pieces that end at each place; a table keeps the one that fits; from the word's end the table leads back to the ids.
The work grows with the length of the word, however long.

No piece has a space mark after another character, and some characters (digits, line ends) are in no longer piece. So a text
can be cut before each run of marks and around such characters, and words can be encoded one by one; each worker remembers
those that it has met of late, up to a fixed number.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Surface of the unknown piece in decoded text, a fixed value.
UNKNOWN = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a model: its size is that of the vocabulary."""

    pieces: list[str]
    scores: list[float]
    first_byte: int
    control: frozenset[int]
    unknown: int


def read_model(path: str) -> Vocabulary:
    """Read a model file on the driver. Models that change characters, drop white space or lack byte pieces are refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    if sp.normalize(f" {every} ") != MARK + f" {every} ".replace(" ", MARK):
        raise ValueError(f"{path}: only models that keep every character and mark the start of a text can be read")
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    found = [i for i in range(n) if sp.is_byte(i)]
    if [pieces[i] for i in found] != [f"<0x{b:02X}>" for b in range(256)] or found[-1] - found[0] != 255:
        raise ValueError(f"{path}: 256 byte pieces in a row are needed")
    plain = [p for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) or any(sp.is_unused(i) for i in range(n)):
        raise ValueError(f"{path}: pieces with an inner space mark and unused pieces are not supported")
    scores = [sp.get_score(i) for i in range(n)]
    return Vocabulary(pieces, scores, found[0], frozenset(i for i in range(n) if sp.is_control(i)), sp.unk_id())


class Codec:
    """Encoder and decoder of one worker."""

    #: Words remembered at most in each of two generations, pairs remembered at most, and the longest word that is.
    WORDS, PAIRS, LONGEST = 1 << 18, 1 << 20, 64

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        v = self.vocabulary = vocabulary
        special = {*range(v.first_byte, v.first_byte + 256), *v.control, v.unknown}
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in special}
        self.score = {p: v.scores[i] for p, i in self.ids.items()}
        self.length = [len(p) for p in v.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1 and self.merged(piece) == [piece]:  # others are never met
                self.automaton.add_word(piece, (i, len(piece), {}))
        self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs, self.fits = 0, [fits for _, _, fits in self.automaton.values()]
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and c != 32)
        self.cut = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|[{lone}]" if lone else "")).findall
        spelt = [b"" if i in v.control else bytes([i - v.first_byte]) if 0 <= i - v.first_byte < 256 else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        spelt[v.unknown] = UNKNOWN.encode()
        self.flat, self.starts, self.lengths = flattened(spelt)

    def merged(self, text: str) -> list[str]:
        """BPE by definition, for the short texts of pieces and pairs: the best pair first, of equal ones the leftmost."""
        symbols, none = list(text), float("-inf")
        scores = [self.score.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = self.score.get(symbols[i - 1] + symbols[i], none)
            if i < len(scores):
                scores[i] = self.score.get(symbols[i] + symbols[i + 1], none)
        return symbols

    def compatible(self, before: int, token: int, fits: dict[int, bool]) -> bool:
        """Whether the text of the pair is encoded as the pair; ``fits`` of the token remembers the answer."""
        if self.pairs >= self.PAIRS:
            self.pairs = 0
            for known in self.fits:
                known.clear()
        a, b = self.vocabulary.pieces[before], self.vocabulary.pieces[token]
        self.pairs += 1
        fits[before] = self.merged(a + b) == [a, b]
        return fits[before]

    def word(self, word: str) -> bytes:
        """Ids of a word, as 32-bit numbers, by its prefix table.

        One token fits at each place, so where none of the longer pieces does it is the character's own piece, which needs no
        test: those entries stay None. A character that no piece has fits beside anything.
        """
        table: list[int | None] = [None] * len(word)
        single = self.ids.get
        for end, (token, length, fits) in self.automaton.iter(word):
            if table[end] is None:
                at = end - length
                if at < 0:
                    table[end] = token
                    continue
                before = table[at]
                if before is None:
                    before = table[at] = single(word[at])
                if before is None or (fit := fits.get(before)) or (fit is None and self.compatible(before, token, fits)):
                    table[end] = token
        out, at = [], len(word) - 1
        while at >= 0:
            token = table[at]
            if token is None:
                token = single(word[at])
            if token is None:
                out += [self.vocabulary.first_byte + b for b in reversed(word[at].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.length[token]
        return array("i", reversed(out)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text of any length; an empty one has none."""
        words = self.cut(MARK + text.replace(" ", MARK)) if text else []
        found = list(map(self.words.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.remembered(words[i])
        return np.frombuffer(b"".join(found), np.int32)

    def remembered(self, word: str) -> bytes:
        """Ids of a word that was not met in this generation; when it is full the one before is forgotten."""
        ids = self.words.get(word) or self.older.get(word) or self.word(word)
        if len(word) <= self.LONGEST:
            if len(self.words) >= self.WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def spelling(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens one after another, with the mark of the start."""
        return spelling(self.flat, self.starts, self.lengths, ids)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the mark of the start goes, byte pieces become characters, each byte that makes none U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if (self.lengths[ids] > 0).all():
            runs = [ids] if len(ids) else []
        else:  # tokens without a text divide runs of byte pieces
            shown = np.flatnonzero(self.lengths[ids] > 0)
            runs = np.split(ids[shown], np.flatnonzero(np.diff(shown) > 1) + 1) if len(shown) else []
        skip = bool(runs) and self.vocabulary.pieces[runs[0][0]].startswith(MARK)
        return "".join(self.spelling(run).decode("utf-8", "byte_by_byte") for run in runs)[skip:]


def flattened(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens in one array, with the start and length of each."""
    lengths = np.array([len(s) for s in spelt], np.int64)
    return np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(lengths) - lengths, lengths


def spelling(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Bytes of tokens one after another."""
    parts = []
    for at in range(0, len(ids), 1 << 16):
        some = ids[at : at + (1 << 16)]
        size = lengths[some]
        ends = np.cumsum(size)
        parts.append(flat[np.repeat(starts[some] - (ends - size), size) + np.arange(ends[-1])].tobytes())
    return b"".join(parts)


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("byte_by_byte", _each_byte)

#: The codec of this worker.
_codecs: list[Codec] = []


def codec(shared) -> Codec:
    """The codec of this worker for a broadcast vocabulary."""
    if not _codecs or _codecs[0].vocabulary is not shared.value:
        _codecs[:] = [Codec(shared.value)]
    return _codecs[0]


def lists(rows: list[np.ndarray], kind=np.int32) -> pa.ListArray:
    """Arrow lists of numbers."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, kind), *rows])))


def slices(b: pa.RecordBatch, column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in a column (texts or lists) hold about ``size`` bytes or items; a longer one is alone."""
    import pyarrow.compute as pc

    values = b.column(column)
    lengths = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < b.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), size, "right")))
        yield b.slice(at, n)
        at += n


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` of each row: the ids of its whole text, without begin or end ids.

    Null and empty texts have no ids. Null ids are kept; repeated rows each get their result; other columns are ignored; an
    empty table gives an empty result. ``model`` is read on the driver; its vocabulary is sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            encode = codec(shared).encode
            yield pa.RecordBatch.from_arrays([b.column(0), lists([encode(t.as_py() or "") for t in b.column(1)])], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encoded, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``(id, ids, text)``: what ``ids`` decode to. A null list is an empty one; an id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            decode = codec(shared).decode
            texts = [decode(x.values.to_numpy() if x.is_valid else []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(decoded, f"id {encoded.schema['id'].dataType.simpleString()}, ids array<int>, text string")
