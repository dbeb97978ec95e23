"""Line deduplication: lines that too many documents share go, everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import rows, texts, unused
from genloom.session import broadcast_limit, ship, stage, table

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def line_prints(text: bytes, shortest: int = 1) -> list[tuple[int, bytes]]:
    """Position and 128-bit hash of the key of each line; lines whose key has under ``shortest`` code points are left out."""
    digest = xxhash.xxh3_128_digest
    keys = [k.strip(b" \t\n\x0b\x0c\r") for k in text.translate(_LOWER).split(b"\n")]
    if shortest <= 1:
        return [(i, digest(k)) for i, k in enumerate(keys) if len(k) >= shortest]
    return [(i, digest(k)) for i, k in enumerate(keys) if len(k.decode()) >= shortest]


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))]


def frequent_lines(docs: DataFrame, least_documents: int = 10, shortest: int = 1) -> DataFrame:
    """Fingerprints ``(a, b)`` of line keys found in ``least_documents`` documents or more; a document is what has an id.

    A key counts once a row because repeats fall out inside the row. Where ids
    tell rows apart that is the count of documents, it needs no (document,
    line) shuffle, and a line in a third of all rows is summed where it is
    read. Where some id occurs twice, keys of its rows count once between them.
    """
    ship(docs.sparkSession)
    named = docs.where("doc_id is not null")
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_several"))
    repeats = not several.isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            own = [list({d for _, d in line_prints(t.encode(), shortest)}) for t in batch.column(1).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *_halves([d for x in own for d in x])], ["doc_id", "a", "b"])

    lines = texts(named).select("doc_id", "text").mapInArrow(run, "doc_id long, a long, b long")
    if repeats:
        several = stage(several, "several")
        of_several = lines.join(several, lines["doc_id"] == several["_several"], "left_semi").distinct()
        lines = lines.join(several, lines["doc_id"] == several["_several"], "left_anti").unionByName(of_several)
    return lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= least_documents)


def exploded(keyed: DataFrame, shortest: int = 1) -> DataFrame:
    """``doc_id, th, pos, a, b`` of each line of ``doc_id, th, text``."""
    ship(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 4 << 20):
            own = [line_prints(t.encode(), shortest) for t in batch.column(2).to_pylist()]
            of = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            pos = pa.array([i for x in own for i, _ in x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pos, *_halves([d for x in own for _, d in x])], ["doc_id", "th", "pos", "a", "b"])

    return keyed.mapInArrow(run, "doc_id long, th long, pos int, a long, b long")


def without_frequent_lines(docs: DataFrame, least_documents: int = 10, shortest: int = 1, broadcast_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, all other columns as they are.

    A line's key is the line without ASCII white space at its ends and with
    A-Z in lower case. Null and empty texts have one empty line, whose key is
    too short to drop. A document is what has an id: rows that repeat one count
    once, and equal rows get equal results; rows without an id count as none
    of the ``least_documents``, but lose lines like any other. A long text is
    exploded into lines, never cut. Columns that ``docs`` already has under
    the three new names are replaced. Frequent fingerprints are broadcast up to
    ``broadcast_bytes`` (default: the session's limit), beyond that the lines
    are joined by shuffle. No rows in, none out.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    frequent = stage(frequent_lines(docs, least_documents, shortest).select("a", "b"), "frequent-lines")
    limit = broadcast_limit(spark) if broadcast_bytes is None else broadcast_bytes
    small = 32 * frequent.count() <= limit

    d, h, mine, lost = (unused(c) for c in ("d", "h", "th", "gone"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(mine, F.xxhash64(text))
    lines = exploded(keyed.select("doc_id", F.col(f"`{mine}`").alias("th"), text.alias("text")), shortest)
    hit = lines.join(F.broadcast(frequent) if small else frequent.hint("merge"), ["a", "b"])
    gone = hit.groupBy("doc_id", "th").agg(F.collect_set("pos").alias(lost))
    gone = stage(gone.select(F.col("doc_id").alias(d), F.col("th").alias(h), lost), "gone-lines")
    # the larger side of this join carries texts; ids are spread by hash, so no key is hot
    joined = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[d]) & (keyed[mine] == gone[h]), "left").drop(d, h, mine)
    all_lines = F.split(text, "\n", -1)
    dropped = F.col(f"`{lost}`")
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), dropped)
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")
    return joined.withColumns(
        {
            "n_lines": F.size(all_lines).cast("long"),
            "n_dropped": F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long"),
            "kept_text": F.when(dropped.isNull(), text).otherwise(rebuilt),
        }
    ).drop(lost)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
