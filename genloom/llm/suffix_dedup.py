"""Removal of repeated byte strings by merged Burrows-Wheeler transforms of anchored segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import rows, text_buffer
from genloom.session import discard, release, ship, stage, table

#: Length of the repeated strings, and of the grams that anchor them.
LENGTH, GRAM = 100, 32
_GRAM_STEPS = 5  # 2 ** 5 = GRAM
_WINDOW = LENGTH - GRAM + 1
_PLACE_BITS = 28
#: Bytes of text whose anchors one task compares; the number of tasks follows from the input.
TASK_BYTES = 32 << 20
#: Symbols of the transforms that are merged at once, and shards that each such lot is sorted in.
CHUNK, SHARDS = 1 << 17, 2
#: Distinct segments of one anchor beyond which a longer anchor parts them.
CROWD = 1024


def _byte_codes() -> np.ndarray:
    """256 well mixed numbers by the splitmix rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _byte_codes()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position, by doubling."""
    h, factor = _CODES[data], np.uint64(0x9E3779B97F4A7C15)
    for step in (1 << k for k in range(_GRAM_STEPS)):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * factor + h[step:]
        with np.errstate(over="ignore"):
            factor = factor * factor
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all LENGTH-byte windows inside rows: hash, position, first and last window start, and row.

    A window's anchor is the gram of smallest hash in it, the leftmost among
    equals, so equal windows have equal anchors at equal distances. Windows
    that share an anchor start next to each other. Data of over ``most`` bytes
    is read in overlapping parts, so that memory is bounded and positions stay within their bits.
    """
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    if len(data) > most:
        parts = []
        for lo in range(0, len(data) - LENGTH + 1, most):
            part = data[lo : lo + most + LENGTH - 1]
            h, at, first, last, row = anchors(part, np.clip(offsets - lo, 0, len(part)), most + LENGTH)
            parts.append((h, at + lo, first + lo, last + lo, row))
        return tuple(np.concatenate(c) for c in zip(*parts))
    h = gram_hashes(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while 2 * reach <= _WINDOW:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < _WINDOW:
        m = np.minimum(m[: len(m) - (_WINDOW - reach)], m[_WINDOW - reach :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(m)]
    starts = np.flatnonzero(np.arange(LENGTH, LENGTH + len(m)) <= offsets[1:][row])
    if not len(starts):
        return none
    at, row = (m[starts] & low).astype(np.int64), row[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    return h[at[new]], at[new], starts[new], starts[last], row[new]


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of sorted strings with their ends: string and offset of each, and its preceding symbol.

    Symbols are bytes plus 1 (UTF-8 has no byte above 0xF4); an end is 0, and
    equal suffixes go by string. The symbol before a whole string is 0. The
    preceding symbols in this order are the Burrows-Wheeler transform.
    """
    sizes = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
    left = np.repeat(first + sizes, sizes) - np.arange(len(text))  # symbols to the end of the string, end included
    key = np.zeros(len(text), np.int64)
    for k in range(7):
        key <<= 8
        key[: len(text) - k] |= np.where(left[: len(text) - k] > k, text[k:], 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
    depth = 7
    while depth < sizes.max() and rank[order[-1]] < len(text) - 1:
        after = np.zeros(len(text), np.int64)
        after[:-depth] = np.where(left[:-depth] > depth, rank[depth:] + 1, 0)
        key = rank * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        depth *= 2
    string = np.repeat(np.arange(len(strings)), sizes)
    before = np.r_[np.uint8(0), text[:-1]]
    return string[order], order - first[string[order]], before[order]


def steps(transforms: list[np.ndarray]) -> np.ndarray:
    """For each row, the row of the suffix one symbol longer; rows are numbered through all shards."""
    out = np.empty(sum(map(len, transforms)), np.int32)
    at = 0
    for t in transforms:
        out[at + np.argsort(t, kind="stable")] = np.arange(at, at + len(t))
        at += len(t)
    return out


def merged_blocks(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several shards' transforms in merged order, and numbers of the blocks that share ``depth`` symbols.

    ``transforms`` are Burrows-Wheeler transforms; rows are numbered through
    all shards. The interleave by h symbols gives the one by h + 2: pass over
    the merged transform, deal each row to the place of the two symbols that
    precede its suffix, keeping the order, and step from the row to the one
    they lead to in its own shard. No suffix is looked at again. A row opens a
    new block if its symbols or the block it came from differ from its
    neighbour's: that round bounds their common prefix. A row alone in its
    block can't be extended to a repeat, and is left out from then on; so is
    one before a string's start.
    """
    if depth % 2:
        raise ValueError("the depth must be even: a round adds two symbols")
    symbols, step = np.concatenate(transforms), steps(transforms)
    further = symbols[step]
    pairs = np.where((symbols > 0) & (further > 0), further.astype(np.uint16) << 8 | symbols, np.uint16(0))
    step = step[step]
    rows_, block = np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32)
    for _ in range(depth // 2):
        read = pairs[rows_]
        inside = np.flatnonzero(read)
        dealt = inside[np.argsort(read[inside], kind="stable")]
        if not len(dealt):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        rows_, read, block = step[rows_[dealt]], read[dealt], block[dealt]
        opens = np.ones(len(dealt) + 1, bool)
        opens[1:-1] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        shared = np.flatnonzero(~(opens[:-1] & opens[1:]))
        rows_, block = rows_[shared], np.cumsum(opens[:-1], dtype=np.int32)[shared]
    return rows_, block


def owners(transforms: list[np.ndarray], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each row, read from the transforms alone: all strings are walked from their ends."""
    symbols, step = np.concatenate(transforms), steps(transforms)
    owner, left = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int32)
    at = np.cumsum([0, *map(len, transforms[:-1])])
    now = np.concatenate([a + np.arange(n) for a, n in zip(at, counts)])
    owner[now] = string = np.arange(len(now))
    size, walked = np.zeros(len(now), np.int32), 0
    while len(now):
        size[string] = walked
        inside = symbols[now] > 0
        now, string, walked = step[now[inside]], string[inside], walked + 1
        owner[now], left[now] = string, walked
    return owner, size[owner] - left


def repeated_windows(transforms: list[np.ndarray], counts: list[int], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each LENGTH-byte window that occurs earlier, at a smaller (doc, start).

    ``transforms`` are those of shards with ``counts`` strings each; ``docs``
    and ``starts`` tell where the strings, numbered through all shards, begin.
    """
    found, block = merged_blocks(transforms, LENGTH)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, place = (x[found] for x in owners(transforms, counts))
    where = starts[owner] + place
    order = np.lexsort((where, docs[owner], block))
    owner, place, where, block = owner[order], place[order], where[order], block[order]
    lead = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    lead = np.repeat(lead, np.diff(np.r_[lead, len(block)]))
    later = (docs[owner] != docs[owner][lead]) | (where != where[lead])
    return owner[later], place[later]


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of integers: each as differences from its least one, in the narrowest type that holds them."""
    out = [np.array([len(columns), len(columns[0])], np.int64).tobytes()]
    for c in columns:
        c = c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)
        least = c.min() if len(c) else np.int64(0)
        off = c.view(np.uint64) - np.array(least).view(np.uint64)
        width = next(w for w in _WIDTHS if not len(c) or off.max() <= np.iinfo(w).max)
        out += [np.array([least, np.dtype(width).itemsize], np.int64).tobytes(), off.astype(width).tobytes()]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    """The columns of ``packed``, as longs."""
    k, n = np.frombuffer(raw, np.int64, 2)
    at, out = 16, []
    for _ in range(k):
        least, size = np.frombuffer(raw, np.int64, 2, at)
        off = np.frombuffer(raw, f"<u{size}", n, at + 16).astype(np.uint64)
        out.append((off + np.array(least).view(np.uint64)).view(np.int64))
        at += 16 + int(n * size)
    return out


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``d`` (the id, null last), ``th`` and ``text``: what tells documents apart here; and whether ids do.

    ``th`` is a hash of the text where some id occurs twice, else 0.
    """
    text = F.coalesce("text", F.lit(""))
    d = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    alone = docs.select(d.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    th = F.lit(0).cast("long") if alone else F.xxhash64(text)
    return docs.select("doc_id", d.alias("d"), th.alias("th"), text.alias("text")), alone


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in rows(batches, 4 << 20):
        data, offsets = text_buffer(batch.column(batch.num_columns - 1))
        lo = int(offsets[0])
        yield batch, data[lo : int(offsets[-1])], offsets - lo


def _earliest(h: np.ndarray, k: np.ndarray, d: np.ndarray, th: np.ndarray, s0: np.ndarray, *more: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns in order of ``h, k, d, s0, th`` without repeated rows; where each ``(h, k)`` begins; and which rows share its first place."""
    order = np.lexsort((th, s0, d, k, h))
    columns = [c[order] for c in (h, k, d, th, s0, *more)]
    differ = lambda *of: np.logical_or.reduce([c[1:] != c[:-1] for c in of])
    once = np.flatnonzero(np.r_[True, differ(*columns[:5])][: len(h)])
    columns = [c[once] for c in columns]
    h, k, d, th, s0 = columns[:5]
    new = np.r_[True, differ(h, k)][: len(h)]
    lead = np.flatnonzero(new)
    lead = np.repeat(lead, np.diff(np.r_[lead, len(h)]))
    return columns, new, (d == d[lead]) & (s0 == s0[lead])


def _dealt(tasks: int):
    """Kernel over ``d, th, text``: ``task, kind, blob``; segments (``kind`` 0) by anchor, and repeats told already (1).

    A segment is all windows of one anchor: window starts ``s0`` to ``s0 +
    span``, with the anchor ``o`` bytes after ``s0``. Hashes of the anchor,
    ``h``, and of the segment with the anchor's place in it, ``k``, name its
    content. Of equal segments within a batch only the first is passed on, so
    a passage that a third of all rows share is few rows of its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch, data, offsets in _batches(batches):
            h, at, lo, hi, row = anchors(data, offsets)
            if not len(h):
                continue
            raw = data.tobytes()
            k = np.array([digest(raw[a:b], c) for a, b, c in zip(lo.tolist(), (hi + LENGTH).tolist(), (at - lo).tolist())], np.uint64)
            d, th = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            columns, _, first = _earliest(h, k, d, th, lo - offsets[row], hi - lo, at - lo)
            out = []
            if not first.all():
                d, th, s0, span = (c[~first] for c in columns[2:6])
                out.append((digest(d.tobytes()) % tasks, 1, packed(d, th, s0, s0 + span + LENGTH)))  # any task will do
            columns = [c[first] for c in columns]
            task = (columns[0] % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            task, columns = task[order], [c[order] for c in columns]
            cut = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            out += [(int(task[a]), 0, packed(*(c[a:b] for c in columns))) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["task", "kind", "blob"])

    return run


_PLACES = "kind int, h long, d long, th long, lo long, hi long, o int"


def _told(crowd: int):
    """Kernel over all ``task, kind, blob`` of one task: ``kind`` 0 repeats, 1 first segments to compare, 2 those of crowded anchors.

    All places of a segment but the first are repeats as a whole. First ones
    matter further where their anchor has other segments as well.
    """

    def out(kind: np.ndarray | int, h: np.ndarray, d: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray, o: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = np.broadcast_to(np.asarray(kind, np.int32), len(h))
        columns = [kind, *(c.astype(np.int64) for c in (h, d, th, lo, hi)), o.astype(np.int32)]
        for at in range(0, len(h), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + (1 << 18)])) for c in columns], [f.split()[0] for f in _PLACES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                columns = unpacked(blob)
                if kind:
                    none = np.zeros(len(columns[0]), np.int64)
                    yield from out(0, none, *columns, none)
                else:
                    held.append(columns)
        if not held:
            return
        (h, k, d, th, s0, span, o), new, first = _earliest(*(np.concatenate(c) for c in zip(*held)))
        del held
        later = ~first
        yield from out(0, h[later], d[later], th[later], s0[later], (s0 + span + LENGTH)[later], o[later])
        anchor = np.cumsum(np.r_[False, h[1:] != h[:-1]])
        kinds = np.bincount(anchor, new)[anchor]
        some = first & (kinds > 1)
        kind = np.where(kinds > crowd, 2, 1)[some]
        yield from out(kind, h[some], d[some], th[some], s0[some], (s0 + span + LENGTH)[some], o[some])

    return run


_SEGMENT = "kind int, h long, d long, th long, s0 long, o int, gram int, seg binary"


def _segments(docs: DataFrame, alone: bool, places: DataFrame) -> DataFrame:
    """``_SEGMENT`` rows: the bytes of the segments at ``places``."""
    place = F.struct("kind", "h", "lo", "hi", "o")
    per_doc = places.groupBy(F.col("d").alias("_d"), F.col("th").alias("_t")).agg(F.collect_list(place).alias("places"))
    # equal rows are one document
    once = docs.select("d", "th", "text") if alone else docs.select("d", "th", "text").dropDuplicates(["d", "th"])
    joined = once.join(per_doc, (once["d"] == per_doc["_d"]) & (once["th"] == per_doc["_t"])).select("d", "th", "places", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 4 << 20):
            found = batch.column(2)
            sizes = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            kind, h, lo, hi, o = flat.flatten()
            d, th = (pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes)) for i in (0, 1))
            at, segs = 0, []
            lows, highs = lo.to_pylist(), hi.to_pylist()
            for n, text in zip(sizes.tolist(), batch.column(3).to_pylist()):
                raw = text.encode()
                segs += [raw[a:b] for a, b in zip(lows[at : at + n], highs[at : at + n])]
                at += n
            gram = pa.array(np.full(len(segs), GRAM, np.int32))
            yield pa.RecordBatch.from_arrays([kind, h, d, th, lo, o, gram, pa.array(segs, pa.binary())], [f.split()[0] for f in _SEGMENT.split(", ")])

    return joined.mapInArrow(run, _SEGMENT)


def longer_anchors(seg: bytes, o: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows of a segment by longer grams around its gram at ``o``: first and last window, place and length of the gram.

    A window that has as much or more room after the gram as before it goes
    with the bytes that follow, others with those that precede, half the room
    in each case; the longer gram lies in all of its windows. Equal windows
    go the same way, and after seven steps the gram is the window.
    """
    room, span = LENGTH - gram, len(seg) - LENGTH
    half = room // 2
    lo = max(0, o - half)
    if lo <= span:
        yield lo, span, o, gram + room - half
    hi = min(span, o - half - 1)
    if hi >= 0:
        yield 0, hi, o - half - 1, gram + half + 1


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over ``_SEGMENT`` rows: ``k`` and a ``_SEGMENT`` row for each longer anchor."""
    digest = xxhash.xxh64_intdigest
    names = ["k", *(f.split()[0] for f in _SEGMENT.split(", "))]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        out = []
        for _, _, d, th, s0, o, gram, seg in zip(*(c.to_pylist() for c in batch.columns)):
            for lo, hi, at, size in longer_anchors(seg, o, gram):
                own = seg[lo : hi + LENGTH]
                h, k = digest(seg[at : at + size], 1 + (at < o)), digest(own, at - lo)
                out.append((k - (k >> 63 << 64), 1, h - (h >> 63 << 64), d, th, s0 + lo, at - lo, size, own))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(types), types)], names)


def _uncrowded(crowd: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """``_SEGMENT`` rows to compare, and ``d, th, lo, hi`` of repeats, for segments of crowded anchors.

    Each step parts the segments by longer anchors, and tells those that are
    equal by then, with sums that start where the rows are read; so no task
    gets a whole crowd.
    """
    ready, repeats = [], []
    columns = [f.split()[0] for f in _SEGMENT.split(", ")]
    while not crowd.isEmpty():
        parted = stage(crowd.select(*columns).mapInArrow(_parted, f"k long, {_SEGMENT}"), "parted")
        first = parted.groupBy(F.col("h").alias("_h"), F.col("k").alias("_k")).agg(F.min(F.struct("d", "s0")).alias("f"), F.count(F.lit(1)).alias("n"))
        first = stage(first, "first")
        kinds = first.groupBy(F.col("_h").alias("_a")).agg(F.count(F.lit(1)).alias("kinds"))
        known = stage(first.join(kinds, first["_h"] == kinds["_a"]).where("n > 1 or kinds > 1").drop("_a"), "known")
        joined = parted.join(known, (parted["h"] == known["_h"]) & (parted["k"] == known["_k"]))
        is_first = (F.col("d") == F.col("f.d")) & (F.col("s0") == F.col("f.s0"))
        joined = stage(joined.select(*columns, "kinds", is_first.alias("is_first")), "settled")
        repeats.append(joined.where("not is_first").select("d", "th", F.col("s0").alias("lo"), (F.col("s0") + F.length("seg")).alias("hi")))
        ready.append(joined.where(f"is_first and kinds between 2 and {CROWD}").select(*columns))
        crowd = joined.where(f"is_first and kinds > {CROWD}")
        discard(parted, first, known)
        release(crowd.sparkSession)
    return ready, repeats


_SHARD = "chunk long, transform binary, strings binary"


def _transforms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over ``chunk, shard, h, d, th, s0, seg`` sorted by chunk and shard: the transform of each shard, and where its strings are."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        held.sort(key=lambda r: r[4])
        _, _, transform = suffix_order([r[4] for r in held])
        strings = packed(*(np.array(c, np.int64) for c in zip(*(r[:4] for r in held))))
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([transform.tobytes()], pa.binary()), pa.array([strings], pa.binary())], ["chunk", "transform", "strings"])

    for batch in batches:
        for chunk, shard, *r in zip(*(c.to_pylist() for c in batch.columns)):
            if (chunk, shard) != now:
                if held:
                    yield done()
                now, held = (chunk, shard), []
            held.append(r)
    if held:
        yield done()


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.r_[True, places[1:] != places[:-1] + 1])
    return places[cut], places[np.r_[cut[1:], len(places)] - 1]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over ``_SHARD`` rows sorted by chunk: ``d, th, lo, hi`` of the repeats in each chunk's merged transform."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        transforms = [np.frombuffer(t, np.uint8) for t, _ in held]
        strings = [unpacked(s) for _, s in held]
        _, d, th, s0 = (np.concatenate(c) for c in zip(*strings))
        owner, place = repeated_windows(transforms, [len(s[0]) for s in strings], d, s0)
        # a window's number leaves a gap between strings, so runs end with their string
        at = np.unique(owner.astype(np.int64) << 32 | place.astype(np.int64))
        lo, hi = _runs(at) if len(at) else (at, at)
        owner, lo, hi = lo >> 32, lo & 0xFFFFFFFF, hi & 0xFFFFFFFF
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (d[owner], th[owner], s0[owner] + lo, s0[owner] + hi + LENGTH)], ["d", "th", "lo", "hi"])

    for batch in batches:
        for chunk, transform, strings in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk != now:
                if held:
                    yield done()
                now, held = chunk, []
            held.append((transform, strings))
    if held:
        yield done()


def _compared(segments: DataFrame, tasks: int) -> DataFrame:
    """``d, th, lo, hi`` of the windows of ``segments`` that occur earlier in another of the same anchor.

    Anchors fall into chunks of about CHUNK symbols. The strings of a chunk
    are sorted in SHARDS shards, by different tasks; their transforms are
    brought together and merged.
    """
    symbols = segments.agg(F.sum(F.length("seg") + 1)).first()[0]
    if not symbols:
        return segments.sparkSession.createDataFrame([], "d long, th long, lo long, hi long")
    chunks = -(-symbols // CHUNK)
    chunk, shard = F.pmod(F.xxhash64("h"), F.lit(chunks)), F.pmod(F.xxhash64("d", "s0"), F.lit(SHARDS))
    dealt = segments.select(chunk.alias("chunk"), shard.alias("shard"), "h", "d", "th", "s0", "seg")
    dealt = dealt.repartitionById(tasks, F.pmod(F.col("chunk") * SHARDS + F.col("shard"), F.lit(tasks)).cast("int"))
    sorted_ = dealt.sortWithinPartitions("chunk", "shard").mapInArrow(_transforms, _SHARD)
    met = sorted_.repartitionById(tasks, F.pmod("chunk", F.lit(tasks)).cast("int")).sortWithinPartitions("chunk")
    return met.mapInArrow(_merged, "d long, th long, lo long, hi long")


def repeated_spans(docs: DataFrame, alone: bool) -> DataFrame:
    """``d, th, spans``: per document the bytes ``[lo, hi)`` that lie in a LENGTH-byte string that starts earlier too.

    Every occurrence of a segment but the first lies wholly in repeats. The
    first ones whose anchor has several segments are compared window by
    window, by merged transforms. Tasks grow in number with the bytes.
    """
    spark = docs.sparkSession
    ship(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    dealt = docs.select("d", "th", "text").mapInArrow(_dealt(tasks), "task int, kind int, blob binary").repartitionById(tasks, "task")
    places = stage(dealt.mapInArrow(_told(CROWD), _PLACES), "places")
    release(spark)
    segments = stage(_segments(docs, alone, places.where("kind > 0")), "segments")
    release(spark)
    ready, repeats = _uncrowded(segments.where("kind = 2"))
    compare = segments.where("kind = 1")
    for more in ready:
        compare = compare.unionByName(more)
    partial = stage(_compared(compare, tasks), "partial")
    discard(segments)
    every = places.where("kind = 0").select("d", "th", "lo", "hi").unionByName(partial)
    for more in repeats:
        every = every.unionByName(more)
    spans = stage(every.groupBy(F.col("d").alias("_d"), F.col("th").alias("_h")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(places, partial)
    release(spark)
    return spans


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` (the remaining bytes) of every row of ``docs``.

    Null counts as empty. Rows that repeat an id and its text are one document
    and get equal results; texts that share an id are told apart by their
    hash, and of equal strings at equal places of those neither is the
    earlier. Texts under LENGTH bytes lose nothing. Other columns are not
    read. No rows in, none out.
    """
    keyed, alone = _keyed(docs)
    per_doc = repeated_spans(keyed, alone)
    joined = keyed.join(per_doc, (keyed["d"] == per_doc["_d"]) & (keyed["th"] == per_doc["_h"]), "left").select("doc_id", "spans", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            out: list[tuple] = []
            for doc, found, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                gone = _union(found or [])
                ends = [0, *(x for s in gone for x in s), len(raw)]
                out.append((doc, len(raw), sum(b - a for a, b in gone), [{"lo": a, "hi": b} for a, b in gone], b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))))
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
