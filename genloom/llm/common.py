"""Pieces that several corpus operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here.
WHITE = "\\x20\\x09-\\x0D"


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the named columns only."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def squeezed(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, f"[{WHITE}]+", " ")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and n + 1 offsets into them, without a copy."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def rows(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most_bytes`` of text, so memory follows the text and not the row count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system: its worker lives on, idle or for other steps, beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def unused(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}-{uuid.uuid4().hex}"


def apart(docs: DataFrame, key: Column, keys: DataFrame, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows that surely have none of ``keys`` (one column of longs), and the others.

    While the keys fit in ``most_bytes``, at 16 bytes each, they are broadcast
    and nothing else is moved; only the second part then needs a shuffle. With
    more keys the first part is empty.
    """
    one = unused("key")
    slim = keys.toDF(one).distinct()
    if 16 * slim.count() > most_bytes:
        return docs.where("false"), docs
    known = F.broadcast(slim)
    return docs.join(known, key == F.col(f"`{one}`"), "left_anti"), docs.join(known, key == F.col(f"`{one}`"), "left_semi")


def once(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``, one row of each distinct pair; rows whose id occurs once are not shuffled."""
    last = F.lit((1 << 63) - 1)
    pairs = docs.select("doc_id", "text")
    several = pairs.groupBy(F.coalesce("doc_id", last).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    alone, some = apart(pairs, F.coalesce(pairs["doc_id"], last), several)
    return alone.unionByName(some.distinct())
