"""Consecutive numbers over all rows of a table, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genloom.session import stage


def numbered(rows: DataFrame, order: list[str], out: str, start: int = 0) -> DataFrame:
    """``rows`` with ``out``: ``start``, ``start + 1`` ... in ``order``, which should tell rows apart.

    Rows are dealt by range and sorted within their part; a row's number is
    the number of rows in the parts before plus its place in its own. Only
    the parts are counted together. The parts are staged, so that both steps
    see the same ones.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = dealt.join(F.broadcast(bases), "_part")
    return joined.withColumn(out, (F.col("_base") + F.col("_place") + start).cast("long")).drop("_part", "_place", "_base")
