"""Putative ancestral haplotypes: sites of one pattern and time, extended to both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genloom.functions import ancestor_name
from genloom.operators.grouping import group_spans
from genloom.session import ship, stage


def descriptors(calls: np.ndarray, times: np.ndarray) -> list[list[int]]:
    """Focal sites of each ancestor, from old to young, then by pattern bytes (missing last), then by site.

    ``calls`` is sites by haplotypes of 0, 1 and -1. Sites of one time and
    pattern are one list, cut between two neighbours if an older site between
    them splits the carriers.
    """
    if calls.shape[0] and calls.shape[1] < 2:
        raise ValueError("two haplotypes at least are needed")
    alike: dict[tuple[float, bytes], list[int]] = {}
    for s in range(len(calls)):
        alike.setdefault((-float(times[s]), calls[s].view(np.uint8).tobytes()), []).append(s)
    out = []
    for key in sorted(alike):
        sites = alike[key]
        carriers = calls[sites[0]] == 1
        between = np.flatnonzero(times[sites[0] : sites[-1]] > times[sites[0]]) + sites[0] if carriers.sum() > 1 else np.zeros(0, int)
        splits = []
        for lot in _lots(len(between), int(carriers.sum())):
            seen = calls[between[lot]][:, carriers]
            ones, called = (seen == 1).sum(axis=1), (seen >= 0).sum(axis=1)
            splits.append(between[lot][(ones != called) & (ones != 0)])
        before = np.searchsorted(np.concatenate(splits) if splits else between[:0], sites)
        out += [run.tolist() for run in np.split(np.array(sites), np.flatnonzero(np.diff(before)) + 1)]
    return out


def _lots(rows: int, width: int, most: int = 16 << 20) -> list[slice]:
    """Rows in lots of about ``most`` cells."""
    step = max(1, most // max(1, width))
    return [slice(k, min(rows, k + step)) for k in range(0, rows, step)]


def _majority(seen: np.ndarray) -> int:
    """1 if ones are at least as many as zeros, -1 without any call."""
    ones, zeros = int((seen == 1).sum()), int((seen == 0).sum())
    return -1 if ones + zeros == 0 else int(ones >= zeros)


def make_ancestor(calls: np.ndarray, times: np.ndarray, derived: np.ndarray, focal: list[int]) -> tuple[int, int, np.ndarray]:
    """First and end site, and the states between, of the ancestor with these focal sites."""
    age = times[focal[0]]
    carriers = np.flatnonzero(calls[focal[0]] == 1)
    if not len(carriers):
        raise ValueError("a focal site has no carriers")
    states = np.full(len(calls), -1, np.int8)
    for lot in _lots(focal[-1] - focal[0], len(carriers)):
        some = slice(focal[0] + lot.start, focal[0] + lot.stop)
        seen = calls[some][:, carriers]
        ones, zeros = (seen == 1).sum(axis=1), (seen == 0).sum(axis=1)
        states[some] = np.where(times[some] > age, np.where(ones + zeros == 0, -1, ones >= zeros), 0)
    states[focal] = 1
    reach = []
    for begin, step in ((focal[-1], 1), (focal[0], -1)):
        holders = np.flatnonzero(calls[begin] == 1)
        astray = np.zeros(len(holders), bool)
        least, s = len(holders) // 2, begin
        while 0 <= s + step < len(calls):
            s += step
            seen = calls[s, holders]
            ones = int((seen == 1).sum())
            agreed = int(ones >= int((seen == 0).sum()))
            off = (seen != agreed) & (seen >= 0)
            older = times[s] > age
            states[s] = _majority(seen) if older else 0
            stay = ~(astray & off)
            if older or derived[s] > ones:
                astray = off
            holders, astray = holders[stay], astray[stay]
            if len(holders) <= least:
                break
        reach.append(s)
    return reach[1], reach[0] + 1, states[reach[1] : reach[0] + 1]


FOUND = "interval_idx int, descriptor int, time double, start_position int, end_position int, first_position int, last_position int, focal_positions array<int>, positions array<int>, hap binary"


_PACKED = "interval_idx int, position int, time double, derived int, haplotypes int, ones binary, called binary"


def packed_sites(sites: DataFrame) -> DataFrame:
    """``_PACKED`` rows of ``interval_idx, position, time, derived, calls``: two bits a call."""
    ship(sites.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            calls = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            planes = [pa.array([r.tobytes() for r in np.packbits(plane, axis=1)], pa.binary()) for plane in (calls == 1, calls >= 0)]
            many = pa.array(np.full(batch.num_rows, calls.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], many, *planes], [f.split()[0] for f in _PACKED.split(", ")])

    rows = sites.select(F.col("interval_idx").cast("int"), F.col("position").cast("int"), F.col("time").cast("double"), F.col("derived").cast("int"), "calls")
    return rows.mapInArrow(run, _PACKED)


_BLOCKS = "interval_idx int, haplotypes int, position binary, time binary, derived binary, ones binary, called binary"


def blocked(packed: DataFrame) -> DataFrame:
    """``_PACKED`` rows, those of a batch and an interval as one row of ``_BLOCKS``."""
    ship(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch])
            for k in pc.unique(batch.column(0)).to_pylist():
                some = found.filter(pc.equal(found["interval_idx"], k)).combine_chunks()
                columns = [some[c].to_numpy().astype(kind).tobytes() for c, kind in (("position", "i4"), ("time", "f8"), ("derived", "i4"))]
                columns += [b"".join(some[c].to_pylist()) for c in ("ones", "called")]
                row = [pa.array([k], pa.int32()), pa.array([some["haplotypes"][0].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)]
                yield pa.RecordBatch.from_arrays(row, [f.split()[0] for f in _BLOCKS.split(", ")])

    return packed.mapInArrow(run, _BLOCKS)


def _unblocked(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, times, derived and calls (0, 1 and -1, sites by haplotypes) of ``_BLOCKS`` rows, by position."""
    if not found.num_rows:
        return np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros((0, 0), np.int8)
    n = found["haplotypes"][0].as_py()
    position, time, derived = (np.frombuffer(b"".join(found[c].to_pylist()), kind) for c, kind in (("position", "i4"), ("time", "f8"), ("derived", "i4")))
    order = np.argsort(position, kind="stable")
    ones, called = (np.frombuffer(b"".join(found[c].to_pylist()), np.uint8).reshape(len(position), -1)[order] for c in ("ones", "called"))
    calls = np.unpackbits(ones, axis=1, count=n).view(np.int8)
    calls[np.unpackbits(called, axis=1, count=n) == 0] = -1
    return position[order], time[order], derived[order], calls


def described(packed: DataFrame, splits: int) -> DataFrame:
    """``interval_idx, descriptor, split, focal``: the numbers of the focal sites of each ancestor; each interval is gone through once."""

    def one(key: tuple, found: pa.Table) -> pa.Table:
        _, times, _, calls = _unblocked(found)
        focal = descriptors(calls, times)
        n = len(focal)
        return pa.table({"interval_idx": pa.array([key[0].as_py()] * n, pa.int32()), "descriptor": pa.array(range(n), pa.int32()), "split": pa.array([k % splits for k in range(n)], pa.int32()), "focal": pa.array(focal, pa.list_(pa.int32()))})

    return blocked(packed).groupBy("interval_idx").applyInArrow(one, "interval_idx int, descriptor int, split int, focal array<int>")


def build(sites: DataFrame, splits: int | None = None) -> DataFrame:
    """Ancestors of inference sites (``interval_idx, position, time, derived, calls``), without ids.

    Intervals are independent. Descriptors are made once an interval; then its
    sites, at two bits a call and a row for each batch, go to ``splits`` tasks
    (one for each 500 sites, 64 and twice the cores at most), each of which
    makes its share of the ancestors. Memory is one interval's matrix a task,
    however many ancestors there are.
    """
    packed = stage(packed_sites(sites), "packed-sites")
    splits = splits or max(1, min(64, 2 * sites.sparkSession.sparkContext.defaultParallelism, packed.count() // 500))

    def one(key: tuple, found: pa.Table, mine: pa.Table) -> pa.Table:
        position, times, derived, calls = _unblocked(found)
        rows = []
        for k, focal in zip(mine["descriptor"].to_pylist(), mine["focal"].to_pylist()):
            a, b, hap = make_ancestor(calls, times, derived, focal)
            rows.append((key[0].as_py(), k, float(times[focal[0]]), int(position[a]), int(position[b - 1]) + 1, int(position[a]), int(position[b - 1]), position[focal], position[a:b], hap.tobytes()))
        types = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        names = [f.split()[0] for f in FOUND.split(", ")]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    dealt = blocked(packed).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return dealt.groupBy("interval_idx", "split").cogroup(described(packed, splits).groupBy("interval_idx", "split")).applyInArrow(one, FOUND)


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``ancestor_id`` and ``sample_id``: by interval, then group of closed spans, then descriptor.

    Ids are made of the spans alone, by interval; the haplotypes are joined to them.
    """
    ship(found.sparkSession)

    def groups(key: tuple, spans: pa.Table) -> pa.Table:
        start, last, time = (spans[c].to_numpy() for c in ("first_position", "last_position", "time"))
        # a span of one site is a whole genome of one site: any length above zero will do
        grp = group_spans(start, np.maximum(last, start + 1), time)
        rank = np.empty(len(grp), np.int64)
        rank[np.lexsort((spans["descriptor"].to_numpy(), grp))] = np.arange(len(grp))
        return spans.select(["interval_idx", "descriptor"]).append_column("rank", pa.array(rank))

    slim = found.select("interval_idx", "descriptor", "first_position", "last_position", "time")
    ranks = slim.groupBy("interval_idx").applyInArrow(groups, "interval_idx int, descriptor int, rank long")
    before = Window.orderBy("interval_idx").rowsBetween(Window.unboundedPreceding, -1)
    bases = found.groupBy("interval_idx").agg(F.count(F.lit(1)).alias("n")).select("interval_idx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ids = ranks.join(bases, "interval_idx").select("interval_idx", "descriptor", (F.col("base") + F.col("rank")).cast("int").alias("ancestor_id"))
    named = found.join(ids, ["interval_idx", "descriptor"]).withColumn("sample_id", ancestor_name("ancestor_id"))
    return named.drop("descriptor")


def transpose(rows: DataFrame, sites: int, block: int = 4096) -> DataFrame:
    """``hap, codes`` (a byte a site, in order of ``site``) of site-major ``site, codes`` rows.

    Each task turns blocks of sites around; a haplotype's blocks are joined in
    order. Sites without a row are missing.
    """
    ship(rows.sparkSession)

    def turn(key: tuple, found: pa.Table) -> pa.Table:
        base = key[0].as_py() * block
        codes = found["codes"].combine_chunks()
        codes = codes.flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
        out = np.full((codes.shape[1], min(block, sites - base)), -1, np.int8)
        out[:, found["site"].to_numpy() - base] = codes.T
        n = len(out)
        return pa.table({"hap": pa.array(range(n), pa.int64()), "block": pa.array([key[0].as_py()] * n, pa.int64()), "bytes": pa.array([r.tobytes() for r in out], pa.binary())})

    def join(key: tuple, found: pa.Table) -> pa.Table:
        whole = np.full(sites, -1, np.int8)
        for b, raw in zip(found["block"].to_pylist(), found["bytes"].to_pylist()):
            whole[b * block : b * block + len(raw)] = np.frombuffer(raw, np.int8)
        return pa.table({"hap": pa.array([key[0].as_py()], pa.int64()), "codes": pa.array([whole.tobytes()], pa.binary())})

    blocks = rows.withColumn("block", F.floor(F.col("site") / block)).groupBy("block").applyInArrow(turn, "hap long, block long, bytes binary")
    return blocks.groupBy("hap").applyInArrow(join, "hap long, codes binary")
