"""Rows of numbers and words held as arrays: a list of tuples to its users, at a few bytes a row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Rows that are kept as tuples before they are made arrays, and that are made tuples at once.
TAIL, LOT = 4096, 65536


class Columns:
    """A list of tuples whose columns have the types of ``kinds``; ``word`` is a string (or any key), held as a number.

    Users append, extend, iterate, index and compare as with a list. Rows can't
    be replaced one by one; ``columns`` and ``of`` are for whole columns.
    """

    def __init__(self, kinds: str, rows: Iterable[tuple] = ()) -> None:
        self.kinds = kinds
        self.words: list = []
        self._number: dict = {}
        self._held = [np.empty(0, "i4" if k == "word" else k) for k in kinds.split()]
        self._parts: list[list[np.ndarray]] = []
        self._tail: list[tuple] = []
        self.extend(rows)

    @classmethod
    def of(cls, kinds: str, columns: Iterable, words: Iterable = ()) -> Columns:
        """Rows of whole columns; those of kind ``word`` have places in ``words``."""
        out = cls(kinds)
        out.words = list(words)
        out._number = {w: k for k, w in enumerate(out.words)}
        out._held = [np.asarray(c, h.dtype) for c, h in zip(columns, out._held)]
        return out

    def code(self, word: object) -> int:
        """The number of a word, a new one if need be."""
        found = self._number.get(word)
        if found is None:
            found = self._number[word] = len(self.words)
            self.words.append(word)
        return found

    def _flush(self) -> None:
        if self._tail:
            pieces = [[self.code(w) for w in c] if k == "word" else c for k, c in zip(self.kinds.split(), zip(*self._tail))]
            self._parts.append([np.array(c, h.dtype) for c, h in zip(pieces, self._held)])
            self._tail = []

    def columns(self) -> list[np.ndarray]:
        """All columns, not to be changed in place; words are numbers in ``words``."""
        self._flush()
        if self._parts:
            self._held = [np.concatenate(cs) for cs in zip(self._held, *self._parts)]
            self._parts = []
        return self._held

    def take(self, order: np.ndarray) -> Columns:
        """The rows of these numbers, in their order."""
        return Columns.of(self.kinds, [c[order] for c in self.columns()], self.words)

    def copy(self) -> Columns:
        return Columns.of(self.kinds, self.columns(), self.words)

    def append(self, row: tuple) -> None:
        self._tail.append(row)
        if len(self._tail) >= TAIL:
            self._flush()

    def extend(self, rows: Iterable[tuple]) -> None:
        if isinstance(rows, Columns) and rows.kinds == self.kinds:
            self._flush()
            new = [self.code(w) for w in rows.words]
            self._parts.append([np.array(new, "i4")[c] if k == "word" and len(c) else c for k, c in zip(self.kinds.split(), rows.columns())])
            return
        for row in rows:
            self.append(row)

    def __iadd__(self, rows: Iterable[tuple]) -> Columns:
        self.extend(rows)
        return self

    def _rows(self, a: int, b: int) -> Iterator[tuple]:
        lists = [c[a:b].tolist() for c in self.columns()]
        return zip(*([self.words[x] for x in c] if k == "word" else c for k, c in zip(self.kinds.split(), lists)))

    def __len__(self) -> int:
        return len(self._held[0]) + sum(len(p[0]) for p in self._parts) + len(self._tail)

    def __iter__(self) -> Iterator[tuple]:
        for a in range(0, len(self), LOT):
            yield from self._rows(a, a + LOT)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return list(self.take(np.arange(len(self))[k]))
        k = range(len(self))[k]
        return next(self._rows(k, k + 1))

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, (Columns, list, tuple)):
            return NotImplemented
        return len(self) == len(other) and all(a == b for a, b in zip(self, other))

    __hash__ = None

    def __repr__(self) -> str:
        return f"Columns({self.kinds!r}, {list(self)!r})"
