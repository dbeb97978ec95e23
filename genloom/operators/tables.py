"""Graph tables as DataFrames: ids, appends, clipping, squashing, path compression, local trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genloom.operators.numbering import numbered
from genloom.operators.treekernel import COMPRESSED


def appended_nodes(jobs: DataFrame, existing: int) -> DataFrame:
    """``id`` of each new node: the number of nodes there are, plus its rank by haplotype index."""
    return numbered(jobs, ["haplotype_index"], "id", existing)


def squashed(edges: DataFrame) -> DataFrame:
    """Edges of one parent and child that touch or overlap, as one."""
    order = Window.partitionBy("parent", "child").orderBy("left", "right")
    reach = F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = edges.withColumn("_new", F.when(F.col("left") <= reach, 0).otherwise(1))
    runs = cut.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("parent", "child", "_run").agg(F.min("left").alias("left"), F.max("right").alias("right")).drop("_run")


def clipped(edges: DataFrame, intervals: DataFrame, bin_size: int) -> DataFrame:
    """Edges cut to the intervals they meet: binned equi-join; a pair counts in the first bin both touch."""

    def bins(frame: DataFrame, lo: str, hi: str) -> DataFrame:
        return frame.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size))))

    both = bins(edges, "left", "right").join(bins(intervals, "start", "end"), "_bin")
    lo, hi = F.greatest("left", "start"), F.least("right", "end")
    once = F.col("_bin") == F.floor(lo / bin_size)
    return both.where((lo < hi) & once).select(lo.alias("left"), hi.alias("right"), "parent", "child")


def compression_groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, children, time`` of the sets of two or more children with equal edge lists that a new node fits above.

    The new node's time is just below its youngest parent, and must be above
    its oldest child.
    """
    one = F.struct("left", "right", "parent")
    paths = edges.groupBy("child").agg(F.sort_array(F.collect_list(one)).alias("path"))
    age = nodes.select(F.col("id").alias("child"), F.col("time").alias("child_time"))
    groups = paths.join(age, "child").groupBy("path").agg(F.sort_array(F.collect_list("child")).alias("children"), F.max("child_time").alias("oldest")).where(F.size("children") >= 2)
    keyed = groups.withColumn("_key", F.xxhash64("path", "children"))
    parents = keyed.select("_key", F.explode("path.parent").alias("parent")).join(nodes.select(F.col("id").alias("parent"), F.col("time").alias("parent_time")), "parent")
    young = parents.groupBy("_key").agg((F.min("parent_time") - 2.0**-32).alias("time"))
    return keyed.join(young, "_key").where("time > oldest").select("path", "children", "time")


def compressed(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes after path compression; new ids follow the largest, in order of the first child."""
    groups = compression_groups(edges, nodes)
    top = nodes.agg(F.max("id")).first()[0]
    named = numbered(groups.withColumn("first_child", F.col("children")[0]), ["first_child"], "id", top + 1)
    up = named.select(F.explode("path").alias("p"), F.col("id").alias("child")).select("p.left", "p.right", "p.parent", "child")
    down = named.select("id", F.explode("children").alias("child"), "path").select("id", "child", F.explode("path").alias("p")).select("p.left", "p.right", F.col("id").alias("parent"), "child")
    rest = edges.join(named.select(F.explode("children").alias("child")), "child", "left_anti").select("left", "right", "parent", "child")
    columns = ["left", "right", "parent", "child"]
    new = named.select("id", "time", F.lit(COMPRESSED).alias("flags"))
    return rest.select(columns).unionByName(up.select(columns)).unionByName(down.select(columns)), nodes.select("id", "time", "flags").unionByName(new)


def parents_at(edges: DataFrame, positions: DataFrame, bin_size: int) -> DataFrame:
    """``position, child, parent`` of the local tree at each position."""
    bins = F.explode(F.sequence(F.floor(F.col("left") / bin_size), F.floor((F.col("right") - 1) / bin_size)))
    cut = edges.withColumn("_bin", bins)
    keyed = positions.withColumn("_bin", F.floor(F.col("position") / bin_size))
    return keyed.join(cut, "_bin").where("left <= position AND position < right").select("position", "child", "parent")
