"""Cut UTF-8 texts at places no token crosses, and gather ragged results of distinct units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def _white(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Mask of ASCII white space bytes that follow a character which is no white space.

    A pre-tokeniser whose tokens hold white space only in front never joins
    the two sides. After a character that Unicode, or some library, may count
    as white space there is no cut; a longer unit is always safe.
    """
    white = _white(data)
    after = np.zeros(len(data), bool)
    if len(data) < 2:
        return after
    before = data[:-1]
    plain = ~white[:-1] & ~((before >= 0x1C) & (before <= 0x1F))
    after[1:] = white[1:] & plain
    wide = np.flatnonzero(after[1:] & (before >= 0x80)) + 1
    if len(wide):
        b1, b2 = data[wide - 1], data[np.maximum(wide - 2, 0)]
        b3 = data[np.maximum(wide - 3, 0)]
        odd = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80)) | ((b3 == 0xE1) & (b2 == 0xA0))
        after[wide[odd]] = False
    return after


def space_cuts(data: np.ndarray) -> np.ndarray:
    """Mask of spaces that follow neither a space nor U+2581, which stands for one."""
    cut = np.zeros(len(data), bool)
    if len(data) < 2:
        return cut
    cut[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    cut[3:] &= ~((data[:-3] == 0xE2) & (data[1:-2] == 0x96) & (data[2:-1] == 0x81))
    return cut


def distinct_units(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct units, each unit's index among them, and n + 1 offsets of the rows' units.

    Units start where ``cuts`` is set and at each row's start; empty rows have none.
    """
    starts_at = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not len(starts_at):
        return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    mask = cuts.copy()
    mask[starts_at] = True
    starts = np.flatnonzero(mask[lo:hi]) + lo
    ends = np.r_[starts, hi].astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = array.dictionary_encode()
    of_row = np.searchsorted(starts, offsets).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), of_row


class Memo:
    """Results of units met lately: two generations of ``most`` units each, and none for units of over 64 bytes."""

    def __init__(self, most: int = 300_000, lot: int = 8192) -> None:
        self.most, self.lot = most, lot
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def resolve(self, found: list[bytes], compute: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The result of each unit; ``compute`` gets those that are not remembered, some at a time."""
        young, old = self.young, self.old
        out = [young.get(u) for u in found]
        fresh = []
        for i, known in enumerate(out):
            if known is None:
                known = old.get(found[i])
                if known is None:
                    fresh.append(i)
                else:
                    out[i] = young[found[i]] = known
        for at in range(0, len(fresh), self.lot):
            some = fresh[at : at + self.lot]
            for i, result in zip(some, compute([found[i] for i in some])):
                out[i] = result
                if len(found[i]) <= 64:
                    young[found[i]] = result
        if len(young) > self.most:
            self.young, self.old = {}, young
        return out


def gather(parts: list[bytes], codes: np.ndarray, of_row: np.ndarray, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the 4-byte numbers in ``parts[c]`` for each code; also n + 1 offsets of the rows in the result."""
    if not len(codes):
        return np.zeros(0, kind), np.zeros(len(of_row), np.int64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat = np.frombuffer(b"".join(parts), kind)
    first = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    ends = np.r_[0, np.cumsum(lengths)]
    at = np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])
    return flat[at], ends[of_row]
