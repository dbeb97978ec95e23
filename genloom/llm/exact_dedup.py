"""Exact deduplication: counting quotient filters route repeated fingerprints to byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import apart, squeezed, unused
from genloom.session import ship, stage, table

#: Bits of a quotient inside a block of the filter, and fingerprints that a block has on average at most.
QUOTIENT_BITS, BLOCK_ROWS = 16, 1 << 18
#: Bits of the routing bitmap for each repeated fingerprint, and its largest size (as powers of two): 32 MB.
ROUTE_PER_KEY, MOST_ROUTE_BITS = 4, 28


class QuotientFilter:
    """A counting quotient filter over the low bits of fingerprints of one block.

    Slots hold remainders, sorted within the run of their quotient, each with
    a count; ``quotients`` are the occupied ones, with the ``lengths`` of their
    runs. Filters of one block merge losslessly and without sorting anew: both
    are in order of quotient and remainder, so each slot of the one is put
    between its neighbours in the other, and counts of equal ones are added.
    """

    def __init__(self, quotients: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.quotients, self.lengths, self.remainders, self.counts = quotients, lengths, remainders, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """From fingerprints of ``width`` bits, sorted and distinct, and how often each occurs."""
        bits = np.uint64(max(1, width - QUOTIENT_BITS))
        quotients, lengths = np.unique(keys >> bits, return_counts=True)
        return cls(quotients.astype(np.uint64), lengths.astype(np.uint32), keys & ((np.uint64(1) << bits) - np.uint64(1)), counts.astype(np.int64))

    def keys(self, width: int) -> np.ndarray:
        """The fingerprints, in order, rebuilt from quotients and remainders."""
        return np.repeat(self.quotients << np.uint64(max(1, width - QUOTIENT_BITS)), self.lengths) | self.remainders

    def merge(self, other: QuotientFilter, width: int) -> QuotientFilter:
        mine, theirs = self.keys(width), other.keys(width)
        at = np.searchsorted(mine, theirs)
        same = at < len(mine)
        same[same] = mine[at[same]] == theirs[same]
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        new = ~same
        return QuotientFilter.build(np.insert(mine, at[new], theirs[new]), np.insert(counts, at[new], other.counts[new]), width)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.quotients), len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.quotients, self.lengths, self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        q, n = np.frombuffer(raw, np.int64, 2)
        at = [16, 16 + 8 * q, 16 + 12 * q, 16 + 12 * q + 8 * n]
        return cls(
            np.frombuffer(raw, np.uint64, q, at[0]),
            np.frombuffer(raw, np.uint32, q, at[1]),
            np.frombuffer(raw, np.uint64, n, at[2]),
            np.frombuffer(raw, np.int64, n, at[3]),
        )


def block_bits(n_rows: int, tasks: int) -> int:
    """Leading bits that name a block: enough for ``tasks`` and for ``BLOCK_ROWS`` a block."""
    return min(40, max(4 * tasks - 1, n_rows // BLOCK_ROWS, 1).bit_length())


def _build(bits: int):
    """Kernel over fingerprints: ``block, filter`` of one partition; after each million those so far are sent on, so memory is bounded."""

    def filters(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        block = keys >> np.uint64(64 - bits)
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        low = np.uint64((1 << (64 - bits)) - 1)
        raw = [QuotientFilter.build(keys[lo:hi] & low, counts[lo:hi], 64 - bits).to_bytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]].astype(np.int64)), pa.array(raw, pa.binary())], ["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= 1 << 20:
                yield from filters(held)
                held, n = [], 0
        if n:
            yield from filters(held)

    return run


def _merge_sorted(bits: int):
    """Kernel over ``block, filter`` sorted by block: fingerprints counted twice or more.

    The filters of a block meet like players of a tournament: those that have
    taken in as many others are merged, so each slot is moved as often as the
    number of filters has binary digits, and that many are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # filters with the number of rounds each has won

        def repeated() -> pa.RecordBatch:
            merged = held[-1][1]
            for _, other in held[-2::-1]:
                merged = merged.merge(other, 64 - bits)
            several = merged.counts > 1
            keys = merged.keys(64 - bits)[several] | (np.uint64(now) << np.uint64(64 - bits))
            return pa.RecordBatch.from_pydict({"fingerprint": pa.array(keys.view(np.int64)), "copies": pa.array(merged.counts[several])})

        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != now:
                    if held:
                        yield repeated()
                    now, held = block, []
                rounds, part = 0, QuotientFilter.from_bytes(raw)
                while held and held[-1][0] == rounds:
                    part = held.pop()[1].merge(part, 64 - bits)
                    rounds += 1
                held.append((rounds, part))
        if held:
            yield repeated()

    return run


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """``fingerprint`` and ``copies`` of each value of the one long column that occurs twice or more.

    Every partition builds its filters by block; blocks are shuffled, and a
    block's filters are merged. Blocks grow in number with the rows. A hot
    fingerprint is one slot with a count in each filter, however many rows
    have it.
    """
    ship(prints.sparkSession)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = prints.count()
    bits, tasks = block_bits(n, parts), max(parts, n // (4 * BLOCK_ROWS))
    filters = prints.mapInArrow(_build(bits), "block long, filter binary")
    blocks = filters.repartition(tasks, "block").sortWithinPartitions("block")
    return blocks.mapInArrow(_merge_sorted(bits), "fingerprint long, copies long")


def _bitmap(prints: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap with the leading bits of each fingerprint set, and how many bits lead; 32 MB at most reach the driver."""
    lead = min(MOST_ROUTE_BITS, max(16, (prints.count() << ROUTE_PER_KEY).bit_length()))
    place = F.shiftrightunsigned("fingerprint", 64 - lead)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fingerprint, {64 - lead}) % 64 as int))")
    words = prints.select(F.shiftright(place, 6).alias("word"), bit.alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (lead - 6), np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64), lead


def routed(rows: DataFrame, fingerprint: str, repeated: DataFrame) -> DataFrame:
    """Rows whose fingerprint may be among the repeated ones, without a shuffle.

    All rows with a repeated fingerprint pass, and about one in ``2 **
    ROUTE_PER_KEY`` others while the bitmap may grow; from 16 million repeated
    fingerprints on, more. Those are told apart by the verification that follows.
    """
    bits, lead = _bitmap(repeated)
    bitmap = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_repeat(prints: pa.Array) -> pa.Array:
        place = prints.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - lead)
        return pa.array(((bitmap.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool))

    return rows.where(may_repeat(F.col(fingerprint)))


def copies(docs: DataFrame, normal: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they agree after each run of ASCII white space became
    one space; null counts as empty, so null and empty texts form one group.
    The smallest ``doc_id`` of a group stays (a null ``doc_id`` only where no
    row has one). Rows that repeat an id and its text count each towards
    ``group_size`` and share ``kept``; ``deduplicated`` keeps one of them.
    """
    ship(docs.sparkSession)
    normal = squeezed(F.coalesce("text", F.lit(""))) if normal is None else normal
    prints = stage(
        docs.select("doc_id", normal.alias("_t")).select("doc_id", F.xxhash64("_t").alias("_fp"), F.unhex(F.sha2("_t", 256)).alias("_sha")),
        "prints",
    )
    repeated = stage(repeated_fingerprints(prints.select("_fp")), "repeated")
    candidates = routed(docs.select("doc_id", normal.alias("_t")).withColumn("_fp", F.xxhash64("_t")), "_fp", repeated)
    groups = (
        candidates.groupBy("_fp", "_t")  # byte verification: whole texts are the key
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("_fp").alias("_g"), F.unhex(F.sha2("_t", 256)).alias("_gsha"), "keep_id", "group_size")
    )
    groups = stage(groups, "groups")
    joined = prints.join(groups, (prints["_fp"] == groups["_g"]) & (prints["_sha"] == groups["_gsha"]), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without later copies, all columns kept; of identical ``(doc_id, text)`` rows one stays.

    Null counts as empty, here as in ``copies``. Different texts under one id
    stay apart. Rows whose id loses no copy are passed on without a shuffle
    while the ids that do can be broadcast.
    """
    several = stage(copies(docs).where("group_size > 1"), "several")
    d, s, sha = unused("d"), unused("s"), unused("sha")
    keyed = several.select(F.col("doc_id").alias(d), F.col("text_sha256").alias(s), "kept")
    told = keyed.groupBy(d, s).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    told = stage(told, "told")
    last = F.lit((1 << 63) - 1)
    whole, some = apart(docs, F.coalesce(docs["doc_id"], last), told.select(F.coalesce(F.col(f"`{d}`"), last)))
    some = some.withColumn(sha, F.sha2(squeezed(F.coalesce("text", F.lit(""))), 256))

    def same(of: DataFrame) -> Column:
        return some["doc_id"].eqNullSafe(of[d]) & (some[sha] == of[s])

    out = whole.unionByName(some.join(told, same(told), "left_anti").drop(sha))
    twice = told.where("kept")
    if not twice.isEmpty():
        out = out.unionByName(some.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", sha]).drop(sha))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
