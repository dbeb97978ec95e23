"""Further sites placed on the local trees by parsimony."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genloom.operators.treekernel import Graph
from genloom.session import ship

_PLACED = "position double, root_state int, mutations array<struct<node:long,code:int>>"


def place_frame(rows: DataFrame, g: Graph, samples: list[int]) -> DataFrame:
    """``position, root_state, mutations`` of each row of ``position, calls, root_state``; a null root state is open.

    Rows are dealt by position, so a task walks a stretch of the genome; the
    graph is broadcast.
    """
    ship(rows.sparkSession)
    told = rows.sparkSession.sparkContext.broadcast((g, samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, leaves = told.value
        trees = graph.trees()
        left, right, parent = next(trees)
        for batch in batches:
            out: list[tuple] = []
            for x, calls, root in zip(*(c.to_pylist() for c in batch.columns)):
                while not x < right:
                    left, right, parent = next(trees)
                out.append((x, *graph.place(parent, leaves, np.array(calls, np.int64).tolist(), root)))
            kind = pa.list_(pa.struct([("node", pa.int64()), ("code", pa.int32())]))
            found = [[{"node": u, "code": c} for u, c in m] for _, _, m in out]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.int32()), pa.array(found, kind)], ["position", "root_state", "mutations"])

    dealt = rows.select("position", "calls", "root_state").repartitionByRange("position").sortWithinPartitions("position")
    return dealt.mapInArrow(run, _PLACED)


def augmented(g: Graph, placed: list[tuple[float, int, list[tuple[int, int]]]], words: dict[float, list[str]]) -> Graph:
    """The graph with the placed sites; ``words`` has the alleles of each position."""
    out = g.copy()
    for x, root, changes in placed:
        out.sites.append((x, words[x][root]))
        out.mutations += [(len(out.sites) - 1, u, words[x][c], -1) for u, c in changes]
    out.sort()
    return out
