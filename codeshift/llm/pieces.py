"""Token ids of text pieces, worked out once per distinct piece.

Both tokenizers split a text into pieces that are encoded independently, so a
batch only needs the ids of its distinct pieces.  They live in flat arrays; a
text is put together by gathering from them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The slices ``flat[at[r]:at[r] + lens[r]]`` of ``rows``, one after the other."""
    n = lens[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(at[rows] - (ends - n), n) + np.arange(total)]


class Rows(dict):
    """Piece -> row; a piece not met before gets the next row and is noted."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, piece):
        row = self[piece] = len(self)
        self.new.append(piece)
        return row


class PieceTable:
    """``encode(list of pieces) -> (ids one after the other, ids per piece)``
    fills the table; when it holds over ``limit`` pieces it starts anew
    (memory stays bounded)."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._row = Rows()
        self._len = np.zeros(0, np.int64)
        self._at = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.uint32)

    def ids(self, texts: list[list]) -> list[np.ndarray]:
        """Ids of each text, given as its list of pieces."""
        if len(self._row) > self._limit:
            self._clear()
        row = self._row.__getitem__
        rows = [np.fromiter(map(row, t), np.int64, len(t)) for t in texts]
        if self._row.new:
            flat, lens = self._encode(self._row.new)
            at = len(self._flat) + np.cumsum(lens) - lens
            self._len, self._at = np.concatenate((self._len, lens)), np.concatenate((self._at, at))
            self._flat = np.concatenate((self._flat, flat.astype(np.uint32)))
            self._row.new = []
        return [gather(self._flat, self._at, self._len, r) for r in rows]
