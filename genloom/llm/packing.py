"""Sum-of-squares packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import rows, text_buffer, texts
from genloom.llm.units import Memo, distinct_units, gather, word_cuts
from genloom.session import ship, stage, table

_NEVER = np.int64(1) << 60


class ByteLevel:
    """Ids of texts by a byte-level tokenizer file; distinct units between white space are encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Memo()

    def fresh(self, units: list[bytes]) -> list[bytes]:
        """Little-endian ids of each unit by the library."""
        found = self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of a column of texts."""
        data, offsets = text_buffer(column)
        found, codes, of_row = distinct_units(data, offsets, word_cuts(data))
        return gather(self.memo.resolve(found, self.fresh), codes, of_row, np.uint32)


_TOKENIZERS: dict[str, ByteLevel] = {}


def byte_level(path: str) -> ByteLevel:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteLevel(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``: its ids and ``end_id``, cut only where longer than ``capacity``.

    Of a cut document the first piece is the shorter one. Null and empty texts
    are one piece of ``end_id`` alone. ``with_ids`` adds the token ids.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            ids, ends = byte_level(tokenizer).encode(batch.column(1))
            ids = ids.astype("<u4")
            out: list[list] = [[] for _ in range(6)]
            for doc, lo, hi in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id))
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = own[a:b]
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(part.tobytes()), part.astype(np.int64) if with_ids else None)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 5 + with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types)], list(names[:n]))

    return texts(docs).mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given.

    ``open_bins[g]`` counts bins with gap ``g``. An item of length s in a bin
    of gap g changes the sum of squares by 2 (open_bins[g - s] - open_bins[g]) + 2;
    it fills a bin up by 1 - 2 open_bins[s], and opens a new one by
    2 open_bins[capacity - s] + 1. The smallest change wins, and the smallest
    gap among equals.
    """
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    open_bins = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = capacity
        if s < capacity:
            there = open_bins[s:capacity]
            change = 2 * (open_bins[: capacity - s] - there) + 2
            change[0] = 1 - 2 * there[0]
            change[there == 0] = _NEVER
            best = int(change.argmin())
            if change[best] <= 2 * open_bins[capacity - s] + 1:
                gap = s + best
        if gap == capacity:
            bin_, made = made, made + 1
        else:
            bin_ = waiting[gap].pop()
            open_bins[gap] -= 1
        bins[k], offsets[k] = bin_, capacity - gap
        if gap > s:
            waiting[gap - s].append(bin_)
            open_bins[gap - s] += 1
    return bins, offsets


def arrival(lengths: np.ndarray, sorted_tail: int = 8192) -> np.ndarray:
    """Order in which items are packed: as given, but the last tenth (``sorted_tail`` at least) from long to short.

    A random order lets the open bins spread over all gaps; the long-to-short
    end leaves short items to fill what is open.
    """
    cut = max(0, len(lengths) - max(sorted_tail, len(lengths) // 10))
    tail = np.argsort(-lengths[cut:], kind="stable") + cut
    return np.r_[np.arange(cut), tail]


def packed(parts: DataFrame, capacity: int = 2048, group_pieces: int = 100_000) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``, from ``length`` and the order of ``doc_id, piece``.

    Pieces fall by hash into groups of about ``group_pieces``, and each group
    is packed by itself: the number of groups grows with the input, and each
    leaves only a few open sequences. Only the columns of ``pieces`` without
    token ids travel. Pieces alike in all columns are packed one by one.
    """
    ship(parts.sparkSession)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    groups = max(1, -(-parts.count() // group_pieces))

    def pack(found: pa.Table) -> pa.Table:
        mixed = np.lexsort([found["piece"].to_numpy(), found["_h"].to_numpy()])
        found = found.take(pa.array(mixed))
        found = found.take(pa.array(arrival(found["length"].to_numpy())))
        bins, offsets = sum_of_squares(found["length"].to_numpy(), capacity)
        ids = found["_g"].to_numpy().astype(np.int64) << 40 | bins
        return found.select(columns).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int")
    keyed = parts.select(*columns, spread.alias("_g"), F.xxhash64("doc_id", "ids_crc32", "piece").alias("_h"))
    return keyed.groupBy("_g").applyInArrow(pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pieces of all rows of ``docs`` and their places; rows that repeat are packed each. No rows in, none out."""
    return packed(stage(pieces(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """``sequence_id`` and ``tokens``: the ids of the pieces of each sequence in order of offset.

    A sequence holds ``capacity`` tokens at most, so a group is bounded.
    ``doc_id`` must tell rows apart.
    """
    parts = stage(pieces(docs, tokenizer, capacity, with_ids=True), "pieces")
    placed = packed(parts.drop("ids"), capacity).select("doc_id", "piece", "sequence_id", "offset")
    joined = parts.join(placed, parts["doc_id"].eqNullSafe(placed["doc_id"]) & (parts["piece"] == placed["piece"]))
    runs = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("runs"))
    return runs.select("sequence_id", F.flatten(F.transform("runs", lambda r: r["ids"])).alias("tokens"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
