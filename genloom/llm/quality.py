"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted text to the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genloom.llm.common import rows, text_buffer, texts
from genloom.session import ship, table

#: Lengths in bytes of the n-grams, and the number of hashed buckets: the models have this size whatever the input.
ORDERS, BUCKETS = (3, 5), 1 << 16
#: A text is refused if its n-grams are on average this much likelier (in nats) in the raw corpus than in trusted
#: text. Trusted text comes out at about 0 and above by definition; half as likely again (log 1.5 is 0.405) is a
#: clear departure. On the labelled documents of sf0.1 none scores between -0.73 and -0.01.
THRESHOLD = -0.4
#: Log ratios are whole numbers of this many parts of a nat, so that sums don't depend on how rows are grouped.
UNIT = 1 << 24
#: Bytes of text that are looked at together: some ten numbers of eight bytes are held for each.
LOT = 1 << 18
_SYMBOLS = bytes(i for i in range(256) if i not in b"[#*$%&|<>]")


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last ``order - 1``."""
    n = max(0, len(data) - order + 1)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = h * np.uint64(1099511628211) + data[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64)


def _inside(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the n-grams of each row; none for shorter rows."""
    lo = offsets[:-1] - offsets[0]
    return lo, np.maximum(lo, offsets[1:] - offsets[0] - order + 1)


def gram_counts(docs: DataFrame, flag: str) -> np.ndarray:
    """Counts of all n-grams of all rows, and of the rows with ``flag``: an array of 2 by BUCKETS.

    Each task sums its own rows; the sums meet by bucket. Only 2 * BUCKETS
    numbers reach the driver.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in rows(batches, LOT):
            data, offsets = text_buffer(batch.column(0))
            data = data[int(offsets[0]) : int(offsets[-1])]
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int8)
            for order in ORDERS:
                found = gram_buckets(data, order)
                lo, hi = _inside(offsets, order)
                turn = np.zeros(len(found) + 1, np.int8)  # where an n-gram is inside a row, and whether that is trusted
                np.add.at(turn, np.minimum(lo, len(found)), 1 + 2 * flags)
                np.add.at(turn, np.minimum(hi, len(found)), -1 - 2 * flags)
                state = np.cumsum(turn[:-1], dtype=np.int8)
                total[0] += np.bincount(found[state > 0], minlength=BUCKETS)
                total[1] += np.bincount(found[state > 1], minlength=BUCKETS)
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind][at])], ["kind", "bucket", "n"])

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text"), flag).mapInArrow(run, "kind int, bucket int, n long")
    sums = parts.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, BUCKETS), np.int64)
    out[sums["kind"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Per bucket, log of its probability in trusted text over that in the raw corpus, each with one count added, in UNITs.

    Without trusted text there is nothing to compare with, and all are 0.
    """
    raw, trusted = counts.astype(np.float64)
    if not trusted.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((trusted + 1) / (trusted.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.rint(ratio * UNIT).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, broadcast_bytes: int = 32 << 20) -> np.ndarray:
    """The log ratios of a corpus and its labels; ``quality = 1`` marks trusted rows.

    Ids of trusted rows are broadcast up to ``broadcast_bytes`` (16 bytes
    each), beyond that joined by shuffle. An id with several labels is trusted
    if one of them says so; rows without a label, or with a null, are not.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    if 16 * labels.count() <= broadcast_bytes:
        good = F.broadcast(good)
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("_good"), "left")
    return log_ratio(gram_counts(marked.select("text", F.col("_good").isNotNull().alias("trusted")), "trusted"))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode()) if n else 0
    symbols = len(text.translate(None, _SYMBOLS)) - text.count(b"[") - text.count(b"]") if text else 0
    seen: set[bytes] = set()
    doubled = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            doubled += line in seen
            seen.add(line)
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, of, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[of] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, doubled, repeated


def ratio_sums(column: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of the weights of all its n-grams, and their number."""
    data, offsets = text_buffer(column)
    data = data[int(offsets[0]) : int(offsets[-1])]
    total, many = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for order in ORDERS:
        lo, hi = _inside(offsets, order)
        running = np.r_[0, np.cumsum(weights[gram_buckets(data, order)])]
        last = len(running) - 1
        total += running[np.minimum(hi, last)] - running[np.minimum(lo, last)]
        many += hi - lo
    return total, many


def verdicts(column: pa.Array, weights: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the base counts, whether it fails the base, its score, and whether it is kept; whole numbers decide."""
    base = np.array([base_counts(t.encode()) for t in column.to_pylist()], np.int64).reshape(-1, 5)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    total, many = ratio_sums(column, weights)
    return base, failed, total / (np.maximum(many, 1) * float(UNIT)), ~failed & (total >= int(threshold * UNIT) * many)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judged(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_type: str = "long") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` of every row.

    The score is the mean log ratio of all n-grams of the whole text, 0 where
    there is none. Null counts as empty; a text of under 50 words, or with
    over half its words in repeated windows of three, fails the base. Rows
    that repeat get equal results; no rows in, none out.
    """
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, LOT):
            base, failed, score, good = verdicts(batch.column(1), told.value, threshold)
            columns = [batch.column(0), *(pa.array(np.ascontiguousarray(base[:, k])) for k in range(5)), pa.array(failed), pa.array(score), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))])

    return texts(docs).mapInArrow(run, f"doc_id {id_type}, {FIELDS}")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, without a shuffle: the verdict is made beside the row.

    Null and empty texts go, as ``judged`` says of them; rows that repeat stay
    or go together. Without labels only the base decides.
    """
    ship(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("boolean")
    def passes(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column.fill_null("").cast(pa.string())], ["text"])
        good = [verdicts(part.column(0), told.value)[3] for part in rows(iter([batch]), LOT)]
        return pa.array(np.concatenate(good) if good else np.zeros(0, bool), pa.bool_())

    return docs.where(passes(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, fit(docs, table(spark, sf_dir, "labels")))
