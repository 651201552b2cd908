"""Per-process tables of what is known about words, so that each distinct word is worked out once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from wardline.llm.shingles import Words

#: Words held per process; a full table is emptied and filled anew, which only costs time.
LIMIT = 250_000
_SLOT_BITS = 20


class WordIndex:
    """Numbers for distinct words: one probe by hash for those seen lately, the rest worked out anew.

    ``work_out`` gets the new words and stores what it finds for them as rows ``used``, ``used + 1``, ...;
    ``clear`` forgets all rows.
    """

    def __init__(self, work_out: Callable[[list[str], int], None], clear: Callable[[], None]):
        self.work_out, self.forget = work_out, clear
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.zeros(1 << _SLOT_BITS, np.uint64), np.zeros(1 << _SLOT_BITS, np.int64)
        self.used = 0
        self.forget()

    @staticmethod
    def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64), (hashes & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)

    def rows(self, words: Words) -> np.ndarray:
        if self.used > LIMIT:
            self.clear()
        hashes = words.hashes
        slot, other = self._slots(hashes)
        out = self.row[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        out[missed] = self.row[other[missed]]
        missed = missed[self.keys[other[missed]] != hashes[missed]]
        if len(missed):
            keys, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            self.work_out([words.word(i) for i in missed[first]], self.used)
            new = np.arange(self.used, self.used + len(keys))
            self.used += len(keys)
            out[missed] = new[back.reshape(-1)]
            slot, other = self._slots(keys)
            at = np.where(self.keys[slot] == 0, slot, other)
            self.keys[at], self.row[at] = keys, new
        return out


class Growing:
    """An array that takes more rows at its end."""

    def __init__(self, kind, width: int | None = None):
        self.data, self.used = np.zeros(4096 if width is None else (4096, width), kind), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.used + len(rows)
        if need > len(self.data):
            grown = np.zeros((max(need, 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            grown[: self.used] = self.data[: self.used]
            self.data = grown
        self.data[self.used : need] = rows
        self.used = need


class RowTable:
    """One fixed-width row of numbers per distinct word."""

    def __init__(self, work_out: Callable[[list[str]], np.ndarray], width: int):
        self.work_out, self.width = work_out, width
        self.index = WordIndex(self._add, self._clear)

    def _clear(self) -> None:
        self.table = Growing(np.float64, self.width)

    def _add(self, words: list[str], _: int) -> None:
        self.table.add(self.work_out(words))

    def lookup(self, words: Words) -> np.ndarray:
        """A row for each word of the batch."""
        at = self.index.rows(words)
        return self.table.data[at]
