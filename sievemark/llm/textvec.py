"""Vector arithmetic over the bytes of a block of texts (numpy inside Spark tasks).

A block is a slice of an Arrow batch whose texts hold about a MB together; one longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
#: Bytes of a span's last eight that belong to it, by their number.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Groups of eight bytes that are taken over all spans at once, and how many of the rest are held together.
_LANES, _SLICE = 4, 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


_SALTS = mix(np.arange(1, _LANES + 1, dtype=np.uint64))
_LANE_SALTS = mix(np.arange(1, 4097, dtype=np.uint64))


class Block:
    """Texts as one byte array: ``data``; text k is ``data[bounds[k]:bounds[k + 1]]``."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = texts.buffers()[2]
        self.data = np.frombuffer(whole, np.uint8)[offsets[0] : offsets[-1]] if whole is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.n = len(texts)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of ``marks`` (one per byte) over each text."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each maximal run of ``inside`` bytes; runs end with their text."""
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        edge = np.zeros(len(inside), bool)
        edge[self.bounds[:-1][self.bounds[:-1] < len(inside)]] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word ``[^\\x20\\x09-\\x0D]+``."""
        return self.runs(~SPACE[self.data])


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name of each ``data[i:i + width]``, from sums modulo 2**64.

    Cheap at every position, but texts can be made whose names collide: good for dealing out, not for telling apart.
    """
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_RANDOM[data] * up[: len(data)], out=total[1:])
    n = len(data) - width + 1
    return mix((total[width:] - total[:n]) * down[:n])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, equal for equal bytes wherever they lie.

    Every eight bytes are scrambled with a salt of their place in the span, and the scrambled values are added up. Long
    spans are added slice by slice, so that memory follows the number of spans and not their length.
    """
    size = ends - starts
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    eights = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    lanes = (size + 7) >> 3

    for j in range(_LANES):
        at = np.flatnonzero(lanes > j)
        if not len(at):
            break
        whole = len(at) == len(size)
        begin, left = (starts, size) if whole else (starts[at], size[at])
        value = mix((eights[begin + 8 * j] & _MASKS[np.minimum(left - 8 * j, 8)]) ^ _SALTS[j])
        if whole:
            out += value
        else:
            out[at] += value
    long = np.flatnonzero(lanes > _LANES)
    edge = np.concatenate(([0], np.cumsum(lanes[long] - _LANES)))
    for a in range(0, int(edge[-1]), _SLICE):
        b = min(a + _SLICE, int(edge[-1]))
        i, j = np.searchsorted(edge, [a, b - 1], "right") - [1, 0]
        which, cuts = long[i:j], np.clip(edge[i : j + 1], a, b)
        lane = np.arange(a, b) - np.repeat(edge[i:j] - _LANES, np.diff(cuts))
        value = eights[np.repeat(starts[which], np.diff(cuts)) + 8 * lane]
        ends = np.flatnonzero(edge[i + 1 : j + 1] <= b)  # the last lane of a span can be shorter
        value[edge[i + 1 : j + 1][ends] - 1 - a] &= _MASKS[size[which[ends]] - 8 * (lanes[which[ends]] - 1)]
        salts = _LANE_SALTS[lane] if lane.max() < len(_LANE_SALTS) else mix(lane.astype(np.uint64) + np.uint64(1))
        out[which] += np.add.reduceat(mix(value ^ salts), cuts[:-1] - a)
    return mix(out)


def shingle_hashes(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words within one text, and the index of its first word."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93)) + words[j : len(words) - k + 1 + j]
    at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
    return mix(h[at]), at


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches whose texts hold about ``limit`` bytes, with their block."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        turn = np.cumsum(lengths) // limit
        cuts = np.flatnonzero(np.diff(turn)) + 1
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(lengths)]))):
            if b > a:
                part = batch.slice(int(a), int(b - a))
                yield part, Block(part.column(column))
