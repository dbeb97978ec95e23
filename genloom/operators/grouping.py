"""Dependency groups of haplotypes: merged spans by window functions, levels by a sweep over older spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genloom.session import ship


def merge_spans(spans: DataFrame, within: str | None = None) -> DataFrame:
    """``spans`` (``start, end, time``) with ``merged``: runs of equal time whose spans overlap, touching not counted.

    ``merged`` is a struct of the run's start, end and time. Equal spans are
    one before anything is sorted, so samples, which share time and span by
    the thousand, are a single row of the window.
    """
    keys = ["time"] if within is None else [within, "time"]
    columns = [*keys, "start", "end"]
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.select(*columns).distinct().withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    runs = cut.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "_run")
    merged = F.struct(F.min("start").over(whole).alias("start"), F.max("end").over(whole).alias("end"), F.col("time").alias("time"))
    return spans.join(runs.select(*columns, merged.alias("merged")), columns)


def levels(start: np.ndarray, end: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Longest chain of strictly older, overlapping spans above each span.

    From old to young, each span looks up the deepest level reached so far
    anywhere below it and leaves one more there. Spans of one time look before
    any of them leaves anything.
    """
    if (end <= start).any():
        raise ValueError("spans must not be empty")
    points, edges = np.unique(np.r_[start, end], return_inverse=True)
    a, b = edges[: len(start)], edges[len(start) :]
    deepest, out = np.zeros(max(1, len(points)), np.int64), np.zeros(len(start), np.int64)
    order = np.argsort(-time, kind="stable")
    k = 0
    while k < len(order):
        upto = k
        while upto < len(order) and time[order[upto]] == time[order[k]]:
            upto += 1
        same = order[k:upto]
        out[same] = [deepest[a[i] : b[i]].max() for i in same]
        for i in same:
            np.maximum(deepest[a[i] : b[i]], out[i] + 1, out=deepest[a[i] : b[i]])
        k = upto
    return out


def group_spans(start: np.ndarray, end: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Group of each span, driver side: merged spans' levels given to all their members."""
    start, end, time = (np.asarray(x) for x in (start, end, time))
    order = np.lexsort((start, time))
    run, reach = np.zeros(len(order), np.int64), None
    for k, i in enumerate(order):
        new = k == 0 or time[i] != time[order[k - 1]] or not start[i] < reach
        reach = end[i] if new else max(reach, end[i])
        run[k] = (run[k - 1] if k else -1) + new
    if not len(order):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lo, hi, t = np.minimum.reduceat(start[order], first), np.maximum.reduceat(end[order], first), time[order][first]
    out = np.empty(len(order), np.int64)
    out[order] = levels(lo, hi, t)[run]
    return out


def assign_groups(spans: DataFrame) -> DataFrame:
    """``spans`` with ``grp``. Merging and un-merging are window functions and a join; only distinct merged spans meet in one task."""
    ship(spans.sparkSession)
    merged = merge_spans(spans)
    distinct = merged.select("merged.*").distinct()

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if found:
            whole = pa.Table.from_batches(found)
            start, end, time = (whole[c].to_numpy() for c in ("start", "end", "time"))
            yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(time), pa.array(levels(start, end, time))], ["ms", "me", "mt", "grp"])

    types = dict(distinct.dtypes)
    level = distinct.repartition(1).mapInArrow(sweep, f"ms {types['start']}, me {types['end']}, mt {types['time']}, grp long")
    same = (F.col("merged.start") == F.col("ms")) & (F.col("merged.end") == F.col("me")) & (F.col("merged.time") == F.col("mt"))
    return merged.join(level, same).drop("merged", "ms", "me", "mt")
