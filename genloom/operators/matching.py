"""Matching of haplotypes in dependency groups, and the graph that grows with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genloom.operators import lshmm
from genloom.operators.columns import Columns
from genloom.operators.treekernel import NULL, SAMPLE, Graph
from genloom.session import ship

#: Default chances of recombination and of mismatch at each site.
RHO, MU = 1e-2, 1e-20
#: Largest panel that is broadcast; one edge takes 40 bytes, so this is 50 million edges.
PANEL_BYTES = 2 << 30
_PATH = "array<struct<left:double,right:double,parent:long>>"
_CHANGES = "array<struct<position:double,code:int>>"


def make_root(positions: Sequence[int], ancestral: list[str], length: float, oldest: float) -> Graph:
    """Two nodes older than all, one edge from the first site to the end, and all sites."""
    g = Graph(float(length))
    g.add_node(oldest + 2)
    g.add_node(oldest + 1)
    if len(positions):
        g.edges = [(float(positions[0]), float(length), 0, 1)]
    words: dict[str, int] = {}
    states = np.fromiter((words.setdefault(a, len(words)) for a in ancestral), np.int32, len(ancestral))
    g.sites = Columns.of(g.sites.kinds, (np.array(positions, float), states), words)
    return g


def active(codes: np.ndarray) -> tuple[int, int]:
    """First and end site that are not missing; all sites if all are."""
    there = np.flatnonzero(codes >= 0)
    return (int(there[0]), int(there[-1]) + 1) if len(there) else (0, len(codes))


def active_frame(haps: DataFrame) -> DataFrame:
    """``hap, first, end``: what ``active`` tells of each row of ``hap, codes``."""
    ship(haps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [active(np.frombuffer(r, np.int8)) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1))], ["hap", "first", "end"])

    return haps.select("hap", "codes").mapInArrow(run, "hap long, first long, end long")


def match_codes(p: lshmm.Panel, codes: np.ndarray, rho: np.ndarray, mu: np.ndarray) -> list[tuple[list[tuple[float, float, int]], Columns]]:
    """Path and differing ``(position, code)`` of each row of ``codes``."""
    spans = np.array([active(c) for c in codes]).reshape(-1, 2)
    # one rate a haplotype: views, not a number for each site
    found = lshmm.match(p, codes, spans[:, 0], spans[:, 1], *(np.broadcast_to(r[:, None], codes.shape) for r in (rho, mu)))
    return [(path, _differing(p, row, states, 0)) for row, (path, states) in zip(codes, found)]


def match_spans(p: lshmm.Panel, starts: list[int], rows: list[bytes], rho: np.ndarray, mu: np.ndarray) -> list[tuple[list[tuple[float, float, int]], Columns]]:
    """The same of rows that have codes from position ``start`` on only; outside these they are missing."""
    sites = len(p.positions)
    codes, offsets, spans = [], np.searchsorted(p.positions, starts), []
    for k, raw in enumerate(rows):
        row = np.frombuffer(raw, np.int8)
        lo, hi = active(row)
        if not len(row) or row[lo] < 0:  # no call at all: every site is gone through
            row, offsets[k], lo, hi = np.full(sites, -1, np.int8), 0, 0, sites
        codes.append(row)
        spans.append((lo + offsets[k], hi + offsets[k]))
    lo, hi = np.array(spans).reshape(-1, 2).T
    found = lshmm.match(p, codes, lo, hi, *(np.broadcast_to(r[:, None], (len(rows), sites)) for r in (rho, mu)), offsets=offsets)
    return [(path, _differing(p, row, states, at)) for row, (path, states), at in zip(codes, found, offsets.tolist())]


def _differing(p: lshmm.Panel, row: np.ndarray, states: np.ndarray, offset: int) -> Columns:
    off = np.flatnonzero((row >= 0) & (row != states))
    return Columns.of("f8 i4", (p.positions[off + offset], row[off]))


def match_frame(haps: DataFrame, p: lshmm.Panel) -> DataFrame:
    """``haplotype_index, path, mutations`` of each row of ``haplotype_index, codes, rho, mu``.

    With a column ``start``, ``codes`` are those from that position on.
    The panel is broadcast: it is the graph, not the genotypes, and its size,
    which must not pass PANEL_BYTES, is that of the edges.
    """
    if p.nbytes() > PANEL_BYTES:
        raise ValueError(f"the panel has {p.nbytes()} bytes; raise PANEL_BYTES if executors can hold it")
    ship(haps.sparkSession)
    told = haps.sparkSession.sparkContext.broadcast(p)
    spans = "start" in haps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = part.column(1).to_pylist()
                rates = (part.column(2).to_numpy(), part.column(3).to_numpy())
                if spans:
                    found = match_spans(told.value, part.column(4).to_pylist(), raw, *rates)
                else:
                    codes = np.array([np.frombuffer(r, np.int8) if isinstance(r, bytes) else r for r in raw], np.int8)
                    found = match_codes(told.value, codes, *rates)
                steps = [x for path, _ in found for x in path]
                left, right, parent = zip(*steps) if steps else ((), (), ())
                step = pa.StructArray.from_arrays([pa.array(left, pa.float64()), pa.array(right, pa.float64()), pa.array(parent, pa.int64())], ["left", "right", "parent"])
                differing = [off.columns() for _, off in found]
                change = pa.StructArray.from_arrays([pa.array(np.concatenate([c[k] for c in differing])) for k in (0, 1)], ["position", "code"])
                paths, changes = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, one)]), pa.int32()), rows) for one, rows in (([path for path, _ in found], step), ([off for _, off in found], change)))
                yield pa.RecordBatch.from_arrays([part.column(0), paths, changes], ["haplotype_index", "path", "mutations"])

    return haps.select("haplotype_index", "codes", "rho", "mu", *["start"] * spans).mapInArrow(run, f"haplotype_index long, path {_PATH}, mutations {_CHANGES}")


def extend(g: Graph, jobs: list[dict], results: dict[int, tuple[list, list]], dictionary: list[list[str]], compress: bool = False, in_place: bool = False) -> Graph:
    """The graph with the group's nodes in order of haplotype index, their edges and mutations.

    ``in_place`` adds the rows to ``g`` itself, unsorted: what a long run does
    between two checkpoints.
    """
    out = g if in_place else g.copy()
    where = out.sites.columns()[0]
    order = np.argsort(where, kind="stable")
    where = where[order]
    for job in sorted(jobs, key=lambda j: j["haplotype_index"]):
        path, off = results[job["haplotype_index"]]
        u = out.add_node(job["time"], job.get("node_flags", SAMPLE), job.get("individual_id", NULL), job.get("population_id", NULL), {k: job[k] for k in ("source", "sample_id", "ploidy_index")})
        out.edges += [(float(a), float(b), int(p), u) for a, b, p in path]
        position, code = (off if isinstance(off, Columns) else Columns("f8 i4", off)).columns()
        sites = order[np.searchsorted(where, position)]
        words: dict[str, int] = {}
        states = [words.setdefault(dictionary[s][c], len(words)) for s, c in zip(sites.tolist(), code.tolist())]
        out.mutations += Columns.of(out.mutations.kinds, (sites, np.full(len(sites), u), states, np.full(len(sites), NULL)), words)
    if not in_place:
        out.sort()
    return out.compress() if compress else out


def match_rows(rows: dict[int, tuple[int, bytes]], p: lshmm.Panel, rate: dict[int, tuple[float, float]]) -> dict[int, tuple[list, Columns]]:
    """Paths and mutations of haplotypes that are at hand, as first position and codes."""
    order = sorted(rows)
    if not order:
        return {}
    starts, codes = zip(*(rows[i] for i in order))
    return dict(zip(order, match_spans(p, list(starts), list(codes), *(np.array([rate[i][k] for i in order]) for k in (0, 1)))))


def match_group(haps: DataFrame, g: Graph, jobs: list[dict], dictionary: list[list[str]], rates: dict[str, tuple[float, float]], local_rows: int = 64, tasks: int = 0, strict: bool = True, fetched: dict[int, tuple[int, bytes]] | None = None) -> dict[int, tuple[list, Columns]]:
    """Paths and mutations of one group's haplotypes against the graph so far.

    A group of up to ``local_rows`` haplotypes is matched where the driver
    is, since a job costs more than that, and not fetched again if its codes
    are in ``fetched``; a larger one goes to executors in ``tasks`` parts, those
    of about one length and place together, so that a task goes through their
    stretch of the sites and not through all.
    """
    p = lshmm.panel(g, np.fromiter((max(2, len(d)) for d in dictionary), np.int16, len(dictionary)), strict)
    rate = {j["haplotype_index"]: rates.get(j["source"], (RHO, MU)) for j in jobs}
    if len(jobs) <= local_rows:
        if fetched is None:
            fetched = {r["haplotype_index"]: (r["start"], r["codes"]) for r in haps.collect()}
        return match_rows({i: fetched[i] for i in rate if i in fetched}, p, rate)
    spark = haps.sparkSession
    table = spark.createDataFrame([(i, float(r), float(m)) for i, (r, m) in rate.items()], "haplotype_index long, rho double, mu double")
    rated = haps.join(F.broadcast(table), "haplotype_index")
    length = F.floor(F.log2(F.length("codes") + 1)).desc()
    tasks = tasks or max(1, len(jobs) // 16, min(len(jobs), spark.sparkContext.defaultParallelism // 2))
    rated = rated.repartitionByRange(tasks, length, "start", "haplotype_index").sortWithinPartitions(length, "start")
    steps = [F.col(f"path.{c}").alias(c) for c in ("left", "right", "parent")]
    found = match_frame(rated, p).select("haplotype_index", *steps, F.col("mutations.position").alias("position"), F.col("mutations.code").alias("code")).toArrow()
    out = {}
    for batch in found.to_batches(max_chunksize=1024):
        lists = [batch.column(k) for k in range(6)]
        for k, i in enumerate(lists[0].to_pylist()):
            path = list(zip(*(c[k].as_py() for c in lists[1:4])))
            out[i] = (path, Columns.of("f8 i4", [c[k].values.to_numpy() for c in lists[4:]]))
    return out
