"""Arrow batches in small pieces, so that a task holds few rows as Python values however many Spark sends at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece, unless one row has more.
PIECE_BYTES = 1 << 20
#: Rows of a piece, as what is made of short texts can be longer than they are.
PIECE_ROWS = 1000


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, halved until a piece has at most so many bytes and rows, or is one row."""
    for b in batches:
        left = [b]
        while left:
            piece = left.pop()
            n = piece.num_rows
            if n > 1 and (n > rows or piece.nbytes > size):
                left += [piece.slice(n // 2), piece.slice(0, n // 2)]
            else:
                yield piece
