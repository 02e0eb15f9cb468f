"""Removal of repeated substrings: every byte covered by a string of ``length`` bytes that also starts earlier.

The strings to compare are all windows of ``length`` bytes. Three steps bring equal windows together without moving texts:

1. Every window is named after its minimizer, the 32-byte piece with the smallest hash in it, so equal windows share it.
   Consecutive windows with one minimizer make a segment (some 35 of them), and only hashes of segments are shuffled.
   Equal segments collapse to their earliest place, first within a task and then by minimizer; the later places are
   repeats throughout. This is where groups of copies end, however large.
2. What is left are minimizers with several different segments. Their bytes are cut from the texts and dealt by minimizer,
   or, where a minimizer has very many segments, window by window, so that no group is large.
3. Each task concatenates segments, builds their Burrows-Wheeler transform and derives the common prefixes of neighbouring
   suffixes by increasing value: the boundaries of the intervals of common prefix l, extended backward by each character,
   are the boundaries of value l + 1. This breadth-first expansion stops at ``length``; suffixes that no boundary parts
   share that many bytes, and all but the earliest are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, materialise, small_batches
from .textvec import BLOCK_BYTES, Block, blocks, mix, rolling_hashes, span_hashes

PIECE = 32
#: Minimizers with more distinct segments than this are dealt window by window.
MANY = 2000
#: Segments that a task collapses at once; bytes that are hashed, compared and transformed at once, or one group.
TOGETHER = 1 << 20
HASHED_BYTES = 1 << 17
SOLVED_BYTES = 1 << 22
TRANSFORM_BYTES = 1 << 15
#: Narrow rows of an Arrow batch; texts are bounded by bytes.
NARROW = 1 << 15
SEPARATOR = 0xFF  # no byte of UTF-8
_HIGH = np.uint64(0xFFFFFFFF00000000)
SEGMENTS = "mini long, seg long, id long, tie long, at long"  # at: start and n, so that a row is narrower
FOUND = "mini long, nth long, id long, tie long, start int, n int"
SPANS = "id long, tie long, start int, n int"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c).cast(types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _packed(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 32) | (n.astype(np.int64) & 0xFFFFFFFF)


def segments(block: Block, length: int) -> tuple[np.ndarray, ...]:
    """Minimizer, segment hash, text, start in the text and number of windows of each segment."""
    data, bounds = block.data, block.bounds
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    h = rolling_hashes(data, PIECE)
    at = np.arange(len(h), dtype=np.int64)
    best = (h & _HIGH) | at.astype(np.uint64)
    width, wide = 1, length - PIECE + 1
    while width * 2 <= wide:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < wide:
        best = np.minimum(best[: width - wide], best[wide - width :])
    place = (best[:n] & ~_HIGH).astype(np.int64)
    whole = np.zeros(n, bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        whole[a : max(a, b - length + 1)] = True
    first = whole.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= first[1:] | ~whole[1:]
    count = np.flatnonzero(last) + 1 - starts
    text = np.repeat(np.arange(block.n), np.diff(np.searchsorted(starts, bounds)))
    return h[place[starts]], span_hashes(data, starts, starts + count + length - 1), text, starts - bounds[text], count


def merged(who: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of intervals, by owner."""
    if not len(who):
        return who, start, stop
    order = np.lexsort((start, who))
    who, start, stop = who[order], start[order], stop[order]
    shift = (who - who[0]).astype(np.int64) * (int(stop.max()) + 1)  # owners are small numbers
    reach = np.maximum.accumulate(stop + shift)
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    firsts = np.flatnonzero(new)
    ends = np.concatenate((firsts[1:], [len(who)])) - 1
    return who[firsts], start[firsts], reach[ends] - shift[ends]


def _segmented(length: int):
    """Segments of a task, each at its earliest place; what repeats one of them within the task is a span (n < 0)."""

    def collapse(held: list) -> Iterator[pa.RecordBatch]:
        mini, seg, doc, start, count, ids, ties = (np.concatenate(x) for x in zip(*held))
        key = mix(mini) + seg
        order = np.argsort(key)
        several = np.zeros(len(key), bool)
        equal = key[order[1:]] == key[order[:-1]]
        several[1:] |= equal
        several[:-1] |= equal
        alone, order = order[~several], order[several]
        order = order[np.lexsort((start[order], ties[doc[order]], ids[doc[order]], seg[order], mini[order]))]
        first = np.ones(len(order), bool)
        first[1:] = (mini[order[1:]] != mini[order[:-1]]) | (seg[order[1:]] != seg[order[:-1]])
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later = (ids[doc[order]] != ids[doc[head]]) | (ties[doc[order]] != ties[doc[head]]) | (start[order] != start[head])
        at = np.concatenate((alone, order[first]))
        if len(at):
            yield _batch(SEGMENTS, _signed(mini[at]), _signed(seg[at]), ids[doc[at]], ties[doc[at]], _packed(start[at], count[at]))
        later = order[later]
        of, a, b = merged(doc[later], start[later], start[later] + count[later] + length - 1)
        if len(of):
            spread = _signed(mix((of.astype(np.uint64) << np.uint64(32)) + a.astype(np.uint64)))
            yield _batch(SEGMENTS, spread, spread, ids[of], ties[of], _packed(a, a - b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = docs = 0
        for part, block in blocks(batches, "text", HASHED_BYTES):
            mini, seg, text, start, count = segments(block, length)
            held.append((mini, seg, text + docs, start, count, part.column(0).to_numpy(), part.column(1).to_numpy()))
            rows, docs = rows + len(mini), docs + block.n
            if rows >= TOGETHER:
                yield from collapse(held)
                held, rows, docs = [], 0, 0
        if held:
            yield from collapse(held)

    return run


def _sorted_places(length: int):
    """From segments in order of minimizer, segment and place: spans (``mini`` is null) and the first places of segments
    whose minimizer has others. Only the state of the last row is kept, whatever the size of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # mini, seg, first place of the segment, number of the segment, first place of the minimizer
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            columns[4:] = columns[4] >> 32, columns[4].astype(np.int32)
            ready = columns[5] < 0
            spans = [x[ready] for x in columns]
            mini, seg, *place = (x[~ready] for x in columns)
            out_spans = [np.stack([*(x.astype(np.int64) for x in spans[2:5]), -spans[5].astype(np.int64)], 1)]
            if len(mini):
                place = np.stack([x.astype(np.int64) for x in place], 1)  # id, tie, start, n
                at = np.arange(len(mini))
                new_mini, new_seg = np.ones(len(mini), bool), np.ones(len(mini), bool)
                new_mini[1:] = mini[1:] != mini[:-1]
                new_seg[1:] = new_mini[1:] | (seg[1:] != seg[:-1])
                goes_on = last is not None and last[0] == mini[0]
                new_mini[0] = not goes_on
                new_seg[0] = not (goes_on and last[1] == seg[0])
                head = np.maximum.accumulate(np.where(new_seg, at, -1))
                first_place = place[np.maximum(head, 0)]
                if not new_seg[0]:
                    first_place[head < 0] = last[2]
                later = ~new_seg & (place[:, :3] != first_place[:, :3]).any(1)
                out_spans.append(np.concatenate((place[later][:, :3], place[later][:, 3:] + length - 1), 1))
                top = np.maximum.accumulate(np.where(new_mini, at, -1))
                order = np.cumsum(new_seg)
                before = np.where(top >= 0, order[np.maximum(top, 0)] - 1, -(last[3] + 1) if goes_on else 0)
                nth = order - 1 - before
                zero = place[np.maximum(top, 0)]
                if goes_on:
                    zero[top < 0] = last[4]
                others = new_seg & (nth > 0)
                opens = others & (nth == 1)  # then the segment before it counts too
                names = np.concatenate((mini[others], mini[opens]))
                if len(names):
                    rows = np.concatenate((place[others], zero[opens]))
                    yield _batch(FOUND, names, np.concatenate((nth[others], np.zeros(opens.sum(), np.int64))), *rows.T)
                last = (mini[-1], seg[-1], first_place[-1], nth[-1], zero[-1])
            rows = np.concatenate(out_spans)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), *_batch(SPANS, *rows.T).columns], names=[f.split()[0] for f in FOUND.split(", ")]
                )

    return run


CUT = "route long, id long, tie long, start int, n int, bytes binary"


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """``data[start:start + size]`` of each, as one array of binaries."""
    edges = _edges(sizes)
    taken = data[np.repeat(starts - edges[:-1], sizes) + np.arange(edges[-1])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(taken)])


def _dealt(data: np.ndarray, a: np.ndarray, n: np.ndarray, mini: np.ndarray, parts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows of crowded minimizers by where the minimizer stands in them: row, first window, number and route of each part.

    The windows of a part share more bytes than the minimizer, and the part is named after all that it shares. Equal windows
    have their minimizer at the same place, so they are in parts of one name.
    """
    wide = length - PIECE + 1
    h = rolling_hashes(data[(a[:, None] + np.arange(length)).ravel()], PIECE)
    h = np.concatenate((h, np.zeros(PIECE - 1, np.uint64))).reshape(-1, length)[:, :wide]
    place = a + np.argmax(h == mini.view(np.uint64)[:, None], axis=1)
    row = np.repeat(np.arange(len(a)), n)
    window = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    part = (place[row] - window) * parts[row] // wide
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
    count = np.diff(np.concatenate((first, [len(row)])))
    row, part = row[first], part[first]
    low, high = (-(-(part + i) * wide // parts[row]) for i in (0, 1))
    return row, window[first], count, _signed(span_hashes(data, place[row] - low, place[row] - high + 1 + length))


def _cut(length: int):
    """The bytes of the segments listed for each text; those of crowded minimizers in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, "text", 4 * BLOCK_BYTES):
            wanted = batch.column(3)
            text = np.repeat(np.arange(block.n), wanted.value_lengths().to_numpy(zero_copy_only=False))
            wanted = wanted.flatten()
            start, n, mini, parts = (wanted.field(c).to_numpy().astype(np.int64) for c in ("start", "n", "mini", "parts"))
            a = block.bounds[text] + start
            ids, ties = (batch.column(c).to_numpy()[text] for c in (0, 1))
            plain = parts == 1
            if plain.any():
                yield _batch(CUT, mini[plain], ids[plain], ties[plain], start[plain], n[plain], _pieces(block.data, a[plain], n[plain] + length - 1))
            at = np.flatnonzero(~plain)
            for some in np.split(at, range(TOGETHER // length, len(at), TOGETHER // length)):
                if not len(some):
                    continue
                row, first, count, route = _dealt(block.data, a[some], n[some], mini[some], parts[some], length)
                row = some[row]
                start_of, size = start[row] + first - a[row], count + length - 1
                # a part that recurs here is sent once; the others travel empty, as spans
                same = span_hashes(block.data, first, first + size)
                order = np.lexsort((start_of, ties[row], ids[row], same, route))
                row, first, count, route, same, start_of, size = (x[order] for x in (row, first, count, route, same, start_of, size))
                new = np.concatenate(([True], (route[1:] != route[:-1]) | (same[1:] != same[:-1])))
                head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                sent = new | ((ids[row] == ids[row[head]]) & (ties[row] == ties[row[head]]) & (start_of == start_of[head]))
                yield _batch(CUT, route, ids[row], ties[row], start_of, np.where(sent, count, -size), _pieces(block.data, first, np.where(sent, size, 0)))

    return run


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes or more; each round joins as many ranks as 64 bits hold, two at least."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    done, bits = 8, n.bit_length()
    while True:
        order = np.argsort(key)
        if done >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        key = rank.copy()
        for j in range(1, 64 // bits):
            key <<= np.uint64(bits)
            key[: max(0, n - j * done)] |= rank[j * done :]
        done *= 64 // bits


def interval_boundaries(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order``: the common prefix with the suffix before, where it is under ``length``, else -1.

    Breadth first over the transform: place q, whose preceding character was last seen at place p, maps to a place that
    parts suffixes of common prefix l + 1 as soon as a boundary of value l lies in (p, q]. Values come in increasing order,
    so the first one is right. Within a run of one character p is q - 1, and a boundary at q is handed on without a search.
    """
    n = len(data)
    before = data[order - 1]
    column = np.argsort(before, kind="stable").astype(np.int64)  # column[LF(q)] = q
    chars = before[column]
    opens = np.concatenate(([True], chars[1:] != chars[:-1]))
    values = np.full(n, -1, np.int16)
    values[opens] = 0
    target = np.flatnonzero(~opens)
    q, p = column[target], column[target - 1]
    run = q == p + 1
    mapped = np.full(n, -1, np.int64)
    mapped[q[run]] = target[run]
    target, q, p = target[~run], q[~run], p[~run]
    fresh = np.flatnonzero(opens)
    for value in range(1, length):
        if not len(fresh):
            break
        flags = np.zeros(n, np.int32)
        flags[fresh] = 1
        seen = np.cumsum(flags, dtype=np.int32)
        hit = seen[q] > seen[p]
        fresh = mapped[fresh]
        fresh = np.concatenate((fresh[fresh >= 0], target[hit]))
        values[fresh] = value
        left = ~hit
        target, q, p = target[left], q[left], p[left]
    return values


def _transformed(data: np.ndarray, starts: np.ndarray, n: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Of the ``n`` windows from each of ``starts`` on, in that order: those equal to one with a smaller ``place``."""
    sizes = n + length
    edges = np.cumsum(sizes) - sizes
    text = data[np.minimum(np.repeat(starts - edges, sizes) + np.arange(sizes.sum()), len(data) - 1)]
    text[edges + sizes - 1] = SEPARATOR
    order = suffix_order(text, length)
    group = np.cumsum(interval_boundaries(text, order, length) >= 0)
    number = np.full(len(text), -1, np.int64)
    number[np.repeat(edges - (np.cumsum(n) - n), n) + np.arange(len(place))] = np.arange(len(place))
    number = number[order]
    group, number = group[number >= 0], number[number >= 0]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    least = np.minimum.reduceat(place[number], np.flatnonzero(first))
    again = np.zeros(len(place), bool)
    again[number] = place[number] != least[np.cumsum(first) - 1]
    return again


def _window_hashes(data: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """A name of each of the ``n`` windows from each of ``starts`` on, which ascend; some rows at once, so that arrays stay small."""
    out = np.empty(n.sum(), np.uint64)
    ends = np.cumsum(n)
    cuts = np.flatnonzero(np.diff(starts // HASHED_BYTES)) + 1
    for i, j in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(n)]))):
        low, done = starts[i], ends[i] - n[i]
        at = np.repeat(starts[i:j] - low - (ends[i:j] - n[i:j] - done), n[i:j]) + np.arange(ends[j - 1] - done)
        out[done : ends[j - 1]] = rolling_hashes(data[low : starts[j - 1] + n[j - 1] + length - 1], length)[at]
    return out


def _repeats(length: int):
    """Repeats among the windows of the segments of a task.

    A window whose hash no other has cannot be a repeat. The transforms hold what is left, in whole groups.
    """

    def solve(batches: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        route, who, tie, start, n = (rows.column(i).to_numpy().astype(np.int64) for i in range(5))
        block = Block(rows.column(5).combine_chunks())
        ready = n < 0
        spans = [np.stack((who[ready], tie[ready], start[ready], -n[ready]), 1)]
        base = block.bounds[:-1][~ready]
        route, who, tie, start, n = (x[~ready] for x in (route, who, tie, start, n))
        if len(n):
            row = np.repeat(np.arange(len(n)), n)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            h = _window_hashes(block.data, base, n, length)
            order = np.argsort(h)
            equal = h[order[1:]] == h[order[:-1]]
            left = np.zeros(len(h), bool)
            left[order[1:][equal]] = True
            left[order[:-1][equal]] = True
            order = np.lexsort((start, tie, who))
            new = np.concatenate(([False], *[(np.diff(np.stack((who, tie, start))[:, order]) != 0).any(0)]))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.cumsum(new)
            place = rank[row] * int(n.max() + 1) + offset
            again = np.zeros(len(h), bool)
            window = np.flatnonzero(left)
            if len(window):
                first = np.flatnonzero(np.concatenate(([True], (np.diff(window) > 1) | (np.diff(row[window]) > 0))))
                count = np.diff(np.concatenate((first, [len(window)])))
                of = row[window[first]]
                begin = base[of] + offset[window[first]]
                reach = np.cumsum(count + length)
                changes = np.flatnonzero(np.diff(route[of])) + 1  # runs of windows before which a group starts
                cuts = changes[np.flatnonzero(np.diff(reach[changes - 1] // TRANSFORM_BYTES, prepend=0))] if len(changes) else changes
                for i, j in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(first)]))):
                    some = window[first[i] : first[j - 1] + count[j - 1]]
                    again[some] = _transformed(block.data, begin[i:j], count[i:j], place[some], length)
            window = np.flatnonzero(again)
            if len(window):
                first = np.flatnonzero(np.concatenate(([True], (np.diff(window) > 1) | (np.diff(row[window]) > 0))))
                count = np.diff(np.concatenate((first, [len(window)])))
                of = row[window[first]]
                spans.append(np.stack((who[of], tie[of], start[of] + offset[window[first]], count + length - 1), 1))
        found = np.concatenate(spans)
        return _batch(SPANS, *found.T) if len(found) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            route = batch.column(0).to_numpy()
            if size >= SOLVED_BYTES:  # a group is held whole
                changes = np.flatnonzero(route != held[-1].column(0)[-1].as_py())
                if len(changes):
                    held.append(batch.slice(0, int(changes[0])))
                    batch = batch.slice(int(changes[0]))
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if sum(x.num_rows for x in held) and (out := solve(held)) is not None:
            yield out

    return run


OUT = "id {id}, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in blocks(batches, "text"):
        found = batch.column(2)
        text = np.repeat(np.arange(block.n), pc.fill_null(found.value_lengths(), 0).to_numpy())
        a, n = (found.flatten().field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
        a += block.bounds[text]
        size = len(block.data) + 1
        removed = np.cumsum(np.bincount(a, minlength=size) - np.bincount(a + n, minlength=size))[:-1] > 0
        gone = block.per_text(removed)
        start, stop, text = block.runs(removed)
        spans = [pa.array((x - block.bounds[text]).astype(np.int32)) for x in (start, stop)]
        spans = pa.ListArray.from_arrays(_edges(np.bincount(text, minlength=block.n)), pa.StructArray.from_arrays(spans, names=["start", "stop"]))
        sizes = np.diff(block.bounds)
        kept = pa.Array.from_buffers(pa.binary(), block.n, [None, pa.py_buffer(_edges(sizes - gone)), pa.py_buffer(block.data[~removed])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(gone), spans, kept], names=["id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` of each row: the removed byte ranges and the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller id, or before in
    the same row. Judged on the input, overlaps count, and matches never cross rows. A null text is empty, a null id
    smaller than all others. Rows with equal ids are ordered by a hash of their text; rows equal in id and text are one
    document and get equal results. Other columns are ignored, whatever their names. An empty table gives an empty result;
    texts of any length are taken whole. Ids are integers, ``length`` is at least 64.
    """
    if length < 2 * PIECE:
        raise ValueError(f"length must be {2 * PIECE} or more")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(
        F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text")
    )
    found = base.select("id", "tie", "text").mapInArrow(_segmented(length), SEGMENTS).repartition("mini")
    found = found.sortWithinPartitions("mini", "seg", "id", "tie", "at").mapInArrow(_sorted_places(length), FOUND)
    with arrow_batches(docs.sparkSession, NARROW):
        found = materialise(found, "segments")
    spans = found.where("mini is null").select("id", "tie", "start", "n")
    several = found.where("mini is not null")
    crowded = several.groupBy("mini").agg(F.max("nth").alias("most")).where(F.col("most") >= MANY)
    parts = F.least(F.lit(length - PIECE + 1), F.ceil((F.col("most") + 1) / MANY)).cast("int")
    crowded = F.broadcast(crowded.select("mini", parts.alias("parts")))  # one at most for each MANY segments that are left
    several = several.join(crowded, "mini", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    listed = several.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n", "mini", "parts")).alias("wanted"))
    cut = base.select("id", "tie", "text").join(listed.hint("shuffle_hash"), ["id", "tie"]).select("id", "tie", "text", "wanted").mapInArrow(_cut(length), CUT)
    solved = cut.repartition("route").sortWithinPartitions("route", "id", "tie", "start").mapInArrow(_repeats(length), SPANS)
    with arrow_batches(docs.sparkSession, NARROW):
        spans = materialise(spans.unionByName(solved), "repeats")
    by_text = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    return base.join(by_text.hint("shuffle_hash"), ["id", "tie"], "left").select("own", "text", "found").mapInArrow(_kept, OUT.format(id=kind))
