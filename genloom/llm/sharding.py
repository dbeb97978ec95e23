"""Weighted rendezvous sharding, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genloom.session import stage, table


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard (from 0) whose draw for ``key`` is best; ties go to the lower shard.

    Each shard draws a uniform number from the XXH64 of the key (as text) and
    its own index. With equal weights the largest draw wins; otherwise the
    largest ``ln(draw) / weight``, so a shard gets rows in proportion to its
    weight. A draw depends on the key and that shard alone: a further shard
    takes rows only into itself, and a shard of weight 0 gets none. A null key
    counts as the empty text.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, and one of them positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    equal = len(set(weights)) == 1
    draws = []
    for i, weight in enumerate(weights):
        if weight == 0:
            continue
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11)
        draw = bits if equal else F.log((bits + 0.5) * 2.0**-53) / weight
        draws.append(F.struct(draw.alias("draw"), F.lit(-i).alias("shard")))
    return (-F.array_max(F.array(*draws))["shard"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard``, and ``grown_shard`` for one more shard of mean weight; columns of these names are replaced."""
    grown = [*weights, sum(weights) / len(weights)]
    return docs.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": rendezvous(F.col(key), grown)})


def numbered(rows: DataFrame, shard: str, order: Sequence[str], block_rows: int = 4096) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within each shard.

    Shards grow with the data, so none is sorted in one task: rows fall into
    hashed blocks of about ``block_rows``, blocks are counted, and a row's slot
    is the number of rows in earlier blocks plus its place in its own block.
    ``order`` should name the columns that tell rows apart; rows equal in all of
    them are interchangeable, and ``block_rows`` of those still share a block.
    """
    n = rows.count()
    shards = max(1, rows.select(shard).distinct().count())
    blocks = max(1, -(-n // (shards * block_rows)))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order, F.lit("block")), F.lit(blocks)))
    counts = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order))
    return (
        rows.withColumn("_place", place)
        .join(starts, [shard, "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_block", "_place", "_start")
    )


def sharded(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """Shard, slot and the shard after growth of every row of ``docs``.

    Law ``key``: ``doc_id`` and the shard count decide. A null ``doc_id`` is a
    key like any other; null and empty texts have size 8 and CRC 0. Rows that
    repeat go to one shard, each with a slot of its own. No rows in, none out.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slim = stage(assign(slim, weights or [1.0] * n_shards), "sharded")
    out = numbered(slim, "shard", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, weights: Sequence[float] | None = None, files: int = 4) -> str:
    """Write whole rows of ``docs`` below ``path``, one folder per shard with about ``files`` files each.

    Folders are named by the column that is returned: ``shard``, or where
    ``docs`` has a column of that name, ``shard_1`` and so on. All columns of
    ``docs`` are written as they are.
    """
    name = next(n for n in ("shard", *(f"shard_{k}" for k in range(1, len(docs.columns) + 2))) if n not in docs.columns)
    placed = docs.withColumn(name, rendezvous(F.col("doc_id"), weights or [1.0] * n_shards))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("file")), F.lit(files))
    placed.repartition(len(weights or [0] * n_shards) * files, name, spread).write.partitionBy(name).parquet(path)
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
