"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import WHITE, apart, rows, texts, unused
from genloom.llm.exact_dedup import routed
from genloom.session import discard, ship, stage, table

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A bucket with more members than this is dealt out again by a second set of masks.
HEAVY = 4096


def shingle_hashes(text: bytes, words: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, joined by spaces, of the text with A-Z lower-cased.

    A text of fewer words is one shingle, a text without words has none.
    """
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if words == 1:
        return np.array([digest(w, 42) for w in (set(found) if distinct else found)], np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), np.int64, len(found)))
    first = np.r_[0, ends[:-words]].tolist()
    last = (ends[words - 1 :] - 1).tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last)], np.uint64)
    return np.unique(hashes) if distinct else hashes


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each non-empty run of hashes, the bits set in over half of them."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    counts = np.diff(np.r_[starts, len(hashes)])
    return np.packbits(2 * ones > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3, distinct: bool = False) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a long) of every row; a text without words has fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2 << 20):
            own = [shingle_hashes(t.encode(), words, distinct) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h in own], np.int64)
            out = np.zeros(len(own), np.uint64)
            if sizes.any():
                full = np.flatnonzero(sizes)
                out[full] = majority(np.concatenate(own), (np.cumsum(sizes) - sizes)[full])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, inner: bool = False) -> list[int]:
    """2 ** (radius + 1) - 2 masks of 64 bits; any ``radius`` bits are all 0 in one of them.

    Every bit has a vector over F2: a 1 followed by ``radius`` places that
    count through all values. Mask v has the bits whose vector has an odd
    product with v. Vectors of ``radius`` bits span no more than ``radius``
    dimensions, so some v other than zero is orthogonal to all of them, and
    words that differ in those bits only agree under mask v. The masks are a
    first-order Reed-Muller code: 32 bits each, but for the one of all 64 bits,
    under which no two words agree; it is left out. ``inner`` deals the vectors
    out in another order, for use within a bucket.
    """
    if not 1 <= radius <= 6:
        raise ValueError("64 bits have structured masks for a radius from 1 to 6")
    lead = 1 << radius
    places = [int(f"{i:06b}"[::-1], 2) if inner else i for i in range(64)]
    vectors = [lead | (i * (2 * i + 1) % 64 if inner else i) % lead for i in places]
    masks = [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, 2 * lead)]
    return [m for m in masks if m != (1 << 64) - 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(prints: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """``bucket, fp`` of each fingerprint under each mask, partitioned and sorted by bucket.

    The bucket number is a hash of the mask and the masked bits; where two
    buckets share a number the distances, taken from whole fingerprints, stay right.
    """
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m")
    rows_ = prints.select("fp", *more, each).select(F.xxhash64("m", F.col("fp").bitwiseAND(F.col("m")), *more).alias("bucket"), "fp")
    return rows_.repartition("bucket").sortWithinPartitions("bucket")


def local_links(prints: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """For each of some distinct fingerprints, the index of the first one in its component."""
    label = np.arange(len(prints))
    while True:
        new = label.copy()
        for lo in range(0, len(prints), block):
            near = np.bitwise_count(prints[lo : lo + block, None] ^ prints[None, :]) <= radius
            new[lo : lo + block] = np.where(near, label[None, :], len(prints)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _linker(radius: int, heavy: int | None):
    """Kernel over ``bucket, fp`` sorted by bucket: ``kind`` 0 links a to b; 1 passes bucket a's member b on."""

    def links(own: np.ndarray, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        first = local_links(own, radius)
        moved = first != np.arange(len(own))
        if moved.any():
            out.append((own[moved], own[first[moved]]))

    def packed(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        passing = None  # the bucket that is too large
        for batch in batches:
            b = np.r_[held_b, batch.column(0).to_numpy(zero_copy_only=False)]
            f = np.r_[held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
            if not len(starts):
                continue
            last = starts[-1]
            out: list[tuple[np.ndarray, np.ndarray]] = []
            ends = np.r_[starts[1:], len(b)]
            for lo, hi in zip(starts[:-1], ends[:-1]):
                if hi - lo == 1 and b[lo] != passing:
                    continue
                if heavy and (b[lo] == passing or hi - lo > heavy):
                    yield packed(1, b[lo:hi].view(np.uint64), f[lo:hi])
                else:
                    links(f[lo:hi], out)
            held_b, held_f = b[last:], f[last:]
            if heavy and (held_b[0] == passing or len(held_b) > heavy):
                passing = held_b[0]
                yield packed(1, held_b.view(np.uint64), held_f)
                held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if out:
                yield packed(0, np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))
        if len(held_f) > 1:
            out = []
            links(held_f, out)
            for x, y in out:
                yield packed(0, x, y)

    return run


def links(prints: DataFrame, radius: int = 3, heavy: int = HEAVY) -> DataFrame:
    """Links ``a, b`` between the distinct values of ``fp``, enough to connect all within ``radius``.

    Each bucket links its members to the first of their component there, not
    all pairs. A bucket of over ``heavy`` members is streamed on and dealt out
    by a second set of masks inside it, which again covers the radius; with
    both masks fixed about 16 bits are free, so those buckets are bounded.
    """
    found = stage(_dealt(prints, covering_masks(radius)).mapInArrow(_linker(radius, heavy), "kind int, a long, b long"), "links")
    large = found.where("kind = 1").select(F.col("a").alias("outer"), F.col("b").alias("fp"))
    out = found.where("kind = 0").select("a", "b")
    if not large.isEmpty():
        inner = _dealt(large, covering_masks(radius, inner=True), "outer").mapInArrow(_linker(radius, None), "kind int, a long, b long")
        out = out.unionByName(stage(inner.select("a", "b"), "inner-links"))
    return out


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` of every end of ``edges``: the smallest end of its component.

    Each round every node takes the smallest label among its neighbours and
    then its label's own label, so chains shorten by more than half. All steps
    are joins and sums over tables in the shared folder.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        lower = stage(told.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = lower.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = stage(lower.join(up, lower["label"] == up["_n"]).select("node", F.least("label", "_up").alias("label")), "labels")
        was = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        now = jumped.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        discard(lower, labels)
        labels = jumped
        if was == now:
            discard(both)
            return labels


def components(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``prints`` (``doc_id, fp``) with ``component_id``: the smallest ``doc_id`` within reach.

    Equal fingerprints are one class from the start, so a group of copies is
    one node however large. Rows that repeat give rows that repeat; a null
    ``doc_id`` names a component only if it has no other.
    """
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = links(classes.select("fp"), radius)
    if edges.isEmpty():
        named = classes.select(F.col("fp").alias("_fp"), F.col("first").alias("component_id"))
    else:
        labels = connected(edges)
        member = classes.join(labels, classes["fp"] == labels["node"]).select("fp", "label", "first")
        least = stage(member.groupBy("label").agg(F.min("first").alias("least")), "least")
        linked = stage(member.join(least, "label").select(F.col("fp").alias("_l"), "least"), "linked")
        named = classes.join(linked, classes["fp"] == linked["_l"], "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "first").alias("component_id"))
    named = stage(named, "named")
    return prints.join(named, prints["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` of every row of ``docs``.

    Null, empty and white texts have fingerprint 0 and are linked like any
    other. Texts are hashed whole. No rows in, none out.
    """
    prints = stage(fingerprints(docs, words), "prints")
    found = components(prints, radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def node_of(docs: DataFrame) -> Column:
    """Names a row by its ``doc_id`` and text, so different texts that share an id stay apart."""
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``node`` and ``shingles``, the distinct shingle hashes, of every row of ``node, text``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2 << 20):
            sets = [np.unique(shingle_hashes(t.encode(), words)).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, words: int = 5) -> DataFrame:
    """``shingle_sets`` of those rows of ``node, text`` whose node is among ``nodes`` (one column), each node once."""
    wanted = nodes.toDF("fingerprint")
    # the bitmap of fixed size spares the texts of all others a shuffle
    some = routed(docs.select("node", "text"), "node", wanted)
    some = some.join(wanted, some["node"] == wanted["fingerprint"], "left_semi").dropDuplicates(["node"])
    return stage(shingle_sets(some, words), "sets")


#: Share of all shingle hashes that the first pass looks at. It is more than a
#: near copy may miss, so a text without repeats elsewhere is told apart by it.
LOOKED = 0.4


def least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that a set of ``n`` has in common, at least, with any of Jaccard similarity ``similarity`` or more."""
    return np.ceil(similarity * n - 1e-6).astype(np.int64)


def _sampled(words: int, similarity: float):
    """Kernel over ``node, text``: ``h, node, need`` of the shingles looked at; ``need`` of them must be repeated."""
    edge = np.uint64(int(LOOKED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 2 << 20):
            out: list[tuple[np.ndarray, int, int]] = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(shingle_hashes(text.encode(), words))
                if not len(own):
                    continue
                seen = own[: np.searchsorted(own, edge)].view(np.int64)
                need = len(seen) - (len(own) - int(least_shared(len(own), similarity)))
                # a set that these shingles cannot rule out says its name twice, which counts as repeated
                out.append((seen, node, need) if need > 0 else (np.array([node, node], np.int64), node, 0))
            sizes = [len(h) for h, _, _ in out]
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h for h, _, _ in out])), *(pa.array(np.repeat(np.array([o[k] for o in out], np.int64), sizes)) for k in (1, 2))],
                    ["h", "node", "need"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, need, n``: of rows ``h, node, need`` sorted by ``h``, how many of a node have an ``h`` that another row has."""
    held, same = [np.zeros(0, np.int64)] * 3, np.zeros(0, bool)

    def told(node: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        each, at, n = np.unique(node, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(each), pa.array(need[at]), pa.array(n)], ["node", "need", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h, node, need = (np.r_[x, batch.column(k).to_numpy(zero_copy_only=False)] for k, x in enumerate(held))
        equal = h[1:] == h[:-1]
        before = np.r_[same if len(same) else False, equal]
        ours = (before | np.r_[equal, False])[:-1]
        yield told(node[:-1][ours], need[:-1][ours])
        held, same = [h[-1:], node[-1:], need[-1:]], before[-1:]
    if len(same) and same[0]:
        yield told(held[1], held[2])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, h, df`` of rows ``h, node, n`` sorted by ``h`` whose ``h`` occurs ``df`` > 1 times."""
    held = [np.zeros(0, np.int64)] * 3

    def told(h: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        sizes = np.diff(np.r_[starts, len(h)])
        df = np.repeat(sizes, sizes)
        several = df > 1
        return pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (node, n, h, df)], ["node", "n", "h", "df"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.r_[x, batch.column(k).to_numpy(zero_copy_only=False)] for k, x in enumerate(held)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        yield told(*(x[:last] for x in now))
        held = [x[last:] for x in now]
    yield told(*held)


def _chained(similarity: float):
    """Kernel over ``h, n, node`` sorted by ``h, n``: links each node to the first of its ``h`` that like sizes lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, node = (np.r_[x, batch.column(k).to_numpy(zero_copy_only=False)] for k, x in enumerate(held))
            starts = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (n[:-1] < similarity * n[1:] - 1e-6)])
            first = np.repeat(node[starts], np.diff(np.r_[starts, len(h)]))
            linked = np.unique(np.stack([node, first], 1)[node != first], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(linked[:, 0].copy()), pa.array(linked[:, 1].copy())], ["a", "b"])
            held = [h[-1:], n[-1:], first[-1:]]

    return run


def _by(frame: DataFrame, *more: str) -> DataFrame:
    return frame.repartition("h").sortWithinPartitions("h", *more)


def candidates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``a, b``, links that connect all pairs of ``similarity`` or more, and ``node, shingles`` of their ends; of rows ``node, text``.

    No pair is lost. A set has ``least_shared`` shingles or more in common with
    a near one, so all sets go that have fewer repeated ones, first by a fixed
    share of the hashes, then by all. With shingles in one order for all sets,
    rare ones first, two near sets also have one in common among the first
    ``n - least_shared + 1`` of each; sets that have, and between whose sizes
    others of that shingle lead in steps of ``similarity`` or more, are linked.
    """
    ship(docs.sparkSession)
    looked = docs.select("node", "text").mapInArrow(_sampled(words, similarity), "h long, node long, need long")
    partly = _by(looked).mapInArrow(_repeated, "node long, need long, n long")
    open_ = partly.groupBy("node", "need").agg(F.sum("n").alias("n")).where("n >= need").select("node").distinct()
    sets = sets_of(docs, stage(open_, "repeating"), words)
    each = sets.select(F.explode("shingles").alias("h"), "node", F.size("shingles").cast("long").alias("n"))
    shared = _by(each).mapInArrow(_shared, "node long, n long, h long, df long")
    least = F.ceil(similarity * F.col("n") - 1e-6)
    ordered = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("found")).where(F.size("found") >= least)
    first = F.slice("found", F.lit(1), (F.size("found") - least + 1).cast("int"))
    prefixes = ordered.select("node", "n", F.explode(first).alias("f")).select(F.col("f")["h"].alias("h"), "n", "node")
    return stage(_by(prefixes, "n").mapInArrow(_chained(similarity), "a long, b long").distinct(), "near-links"), sets


def print_groups(docs: DataFrame, words: int = 5, radius: int = 3) -> DataFrame:
    """``member, comp`` of the rows of ``node, text`` that others are linked to by the covering tables, over fingerprints of sets of shingles.

    A group is named by its smallest node. Texts without words are in none.
    """
    some = docs.where(F.col("text").rlike(f"[^{WHITE}]")).select(F.col("node").alias("doc_id"), "text")
    prints = stage(fingerprints(some, words, distinct=True), "prints-of-sets")
    linked = components(prints, radius).where("doc_id <> component_id").select(F.col("doc_id").alias("member"), F.col("component_id").alias("comp"))
    linked = stage(linked.distinct(), "print-links")
    return stage(linked.unionByName(linked.select(F.col("comp").alias("member"), "comp").distinct()), "print-groups")


#: Members of a component that are settled together in one task.
TOGETHER = 256


#: What is told of a row that goes: ``judge`` is the node of the one that stays.
_GONE = ("node", "doc_id", "keep_id", "judge")


def _settled(similarity: float):
    """Kernel over one component (``node, doc_id, comp, shingles``): each member goes that is near a smaller node that stays."""

    def run(found: pa.Table) -> pa.Table:
        found = found.sort_by("node")
        column = found["shingles"].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        sets = [values[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
        stay: list[int] = []
        gone: list[tuple[int, int, int, int]] = []
        ids, nodes = found["doc_id"].to_pylist(), found["node"].to_pylist()
        for i, own in enumerate(sets):
            for k in stay:
                if min(len(own), len(sets[k])) < similarity * max(len(own), len(sets[k])) - 1e-6:
                    continue
                shared = len(np.intersect1d(own, sets[k], assume_unique=True))
                if shared >= similarity * (len(own) + len(sets[k]) - shared):
                    gone.append((nodes[i], ids[i], ids[k], nodes[k]))
                    break
            else:
                stay.append(i)
        return pa.table({name: pa.array([g[k] for g in gone], pa.int64()) for k, name in enumerate(_GONE)})

    return run


def settled(named: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """_GONE of the rows of ``node, doc_id`` that go within the groups (``member, comp``), by ``node, shingles``.

    Components of up to TOGETHER members are settled in one task each. Of a
    larger one about half as many, the first in order, are settled; those that
    stay are compared with all others by a join, and what is left is counted
    anew, which comes to the same.
    """
    kind = ", ".join(f"{c} long" for c in _GONE)
    ids = routed(named.select("node", "doc_id"), "node", groups.select(F.col("member").alias("fingerprint")))
    members = stage(ids.distinct().join(groups, F.col("node") == F.col("member")).select("member", "doc_id", "comp"), "members")
    open_ = stage(sets.join(members, sets["node"] == members["member"]).select("node", "doc_id", "comp", "shingles"), "open")
    out = None
    while True:
        counted = open_.groupBy(F.col("comp").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"))
        counted = stage(counted.where("n > 1"), "counted")
        small = counted.where(F.col("n") <= TOGETHER)
        mine = open_.join(small, open_["comp"] == small["c"], "left_semi")
        found = stage(mine.groupBy("comp").applyInArrow(_settled(similarity), kind), "settled")
        out = found if out is None else out.unionByName(found)
        large = counted.where(F.col("n") > TOGETHER)
        if large.isEmpty():
            return out
        # of each larger component the first nodes settle, as many as even hashes put there, and judge the rest
        parts = F.ceil(F.col("n") / (TOGETHER / 2))
        lead = F.col("lead").cast("double")
        now = F.col("node").cast("double") <= lead + (F.lit(2.0**63) - lead) / parts
        dealt = stage(open_.join(large, open_["comp"] == large["c"]).select("node", "doc_id", "comp", "shingles", now.alias("now")), "dealt")
        some, rest = dealt.where("now").drop("now"), dealt.where("not now").drop("now")
        first = stage(some.groupBy("comp").applyInArrow(_settled(similarity), kind), "settled")
        judges = stage(some.join(first, "node", "left_anti").select(F.col("comp").alias("c"), F.col("node").alias("judge"), F.col("doc_id").alias("judge_id"), F.col("shingles").alias("theirs")), "judges")
        least, most = F.least(F.size("shingles"), F.size("theirs")), F.greatest(F.size("shingles"), F.size("theirs"))
        shared = F.size(F.array_intersect("shingles", "theirs"))
        near = (least >= similarity * most - 1e-6) & (shared >= similarity * (F.size("shingles") + F.size("theirs") - shared))
        told = rest.join(judges, rest["comp"] == judges["c"]).where(near)
        told = stage(told.groupBy("node", "doc_id").agg(F.min_by("judge_id", "judge").alias("keep_id"), F.min("judge").alias("judge")), "told")
        out = out.unionByName(first).unionByName(told)
        left = stage(rest.join(told, "node", "left_anti"), "open")
        discard(open_, counted, dealt, judges)
        open_ = left


def _without(docs: DataFrame, nodes: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` whose node is not among ``nodes`` (``node``); without a shuffle while the nodes, at 16 bytes, fit in ``most_bytes``."""
    slim = nodes.select("node").distinct()
    return docs.join(F.broadcast(slim) if 16 * slim.count() <= most_bytes else slim, "node", "left_anti")


def touching(docs: DataFrame, some: DataFrame, words: int = 5, similarity: float = 0.8, most_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``docs`` that share enough shingles with all of ``some`` (both ``node, text``) together to be near one of them.

    All rows if the shingles of ``some`` pass ``most_bytes``.
    """
    told = stage(shingle_sets(some, words).select(F.explode("shingles").alias("h")).distinct(), "theirs")
    if 8 * told.count() > most_bytes:
        return docs
    theirs = docs.sparkSession.sparkContext.broadcast(np.sort(told.toArrow()["h"].to_numpy()))

    @F.arrow_udf("boolean")
    def enough(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            own = np.unique(shingle_hashes(text.encode(), words)).view(np.int64)
            at = np.minimum(np.searchsorted(theirs.value, own), len(theirs.value) - 1)
            out.append(bool(len(own)) and bool((theirs.value[at] == own).sum() >= least_shared(np.array(len(own)), similarity)))
        return pa.array(out, pa.bool_())

    return docs.where(enough(F.col("text")))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``node, doc_id, keep_id, judge`` of each row of ``docs`` that is a near copy of one that stays.

    One rule, whatever the number of near copies: in order of ``node_of``, a
    hash of ``doc_id`` and text, each row goes whose set of ``words``-word
    shingles has a Jaccard similarity of ``similarity`` or more with that of an
    earlier one that stays. The covering tables link sets whose fingerprints
    are near, and what goes by those links is settled first. One fingerprint
    can't reach all pairs of that similarity, so ``candidates`` links, exactly,
    what is left. If a row goes there that had judged others, these come back
    and are settled with all they may be near to, until each row that went has
    a judge that stays. No two rows that stay are near then, which only the
    rule's own result fulfils.

    A text of fewer words is one shingle; texts without words have none and
    stay. A row without ``doc_id`` stays; texts that share an id are judged
    each by itself.
    """
    ship(docs.sparkSession)
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), node_of(docs).alias("node"))
    groups = print_groups(named, words)
    gone = docs.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in _GONE))
    if not groups.isEmpty():
        gone = settled(named, groups, sets_of(named, groups.select("member"), words), similarity)
    open_ = _without(named, gone)
    while True:
        edges, sets = candidates(open_, words, similarity)
        if edges.isEmpty():
            return gone
        labels = connected(edges).select(F.col("node").alias("member"), F.col("label").alias("comp"))
        more = settled(open_, labels, sets, similarity)
        judges = more.select(F.col("node").alias("judge")).distinct()
        back = stage(gone.join(judges, "judge", "left_semi").select("node").distinct(), "back")
        gone = stage(gone.join(judges, "judge", "left_anti").select(*_GONE).unionByName(more), "gone")
        if back.isEmpty():
            return gone
        stay = _without(named, gone)
        open_ = stage(touching(stay, stay.join(back, "node", "left_semi"), words, similarity), "touching")


def without_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows that ``near_copies`` tells.

    Rows whose id is not among those are passed on without a shuffle while
    the ids can be broadcast.
    """
    node = unused("node")
    gone = stage(near_copies(docs, words, similarity).select(F.col("node").alias(node), "doc_id").distinct(), "near-copies")
    whole, some = apart(docs, F.coalesce(docs["doc_id"], F.lit((1 << 63) - 1)), gone.select("doc_id"))
    gone = gone.drop("doc_id")
    return whole.unionByName(some.join(gone, some["doc_id"].isNotNull() & (node_of(some) == gone[node]), "left_anti"))
