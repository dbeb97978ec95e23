"""Session helpers shared by every operator: table access, staging, code shipping."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; any URI that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that setting is empty (tests, one machine) is a local folder
    made and set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="genloom-shared-")
    if current.isEmpty():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = f"{shared_dir(spark)}/genloom/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and gives later joins true file
    sizes. The files go with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._genloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*staged: DataFrame) -> None:
    """Delete the files of tables from ``stage`` that nothing will read again."""
    for df in staged:
        _delete(df.sparkSession, df._genloom_path)
        _STAGED.remove((df.sparkSession, df._genloom_path))


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now.

    It does so when the driver collects its garbage, which a driver with
    little to do may put off while the files of a long query pile up.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let the executors collect their garbage now, so that a heap that a step has made grow shrinks before the next.

    Else it stays as large as it ever was, beside the Python workers of the
    steps that follow. As many small tasks as there are cores reach them all.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    collected = F.expr("java_method('java.lang.System', 'gc')")
    spark.range(0, n, 1, n).select(collected.alias("gc")).write.format("noop").mode("overwrite").save()


def _unstage() -> None:
    for spark, path in _STAGED:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_unstage)


#: Bytes of an Arrow batch that kernels get, and the setting and its default that this replaces.
BATCH_BYTES = 8 << 20
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Also bounds the Arrow batches of the session to BATCH_BYTES, unless the
    user has set another bound: each is held by the JVM and by a worker at once.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, None) == _BATCH_DEFAULT and not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    if getattr(sc, "_genloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="genloom-"), "genloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._genloom_shipped = True


#: Bytes of a table of the driver beyond which it stays in Arrow batches.
LOCAL_BYTES = 1 << 20


def from_arrow(spark: SparkSession, rows: pa.Table, schema: str) -> DataFrame:
    """A table of the driver. Large ones stay in Arrow batches there: Spark makes those below 48 MB an object a row."""
    key = "spark.sql.execution.arrow.localRelationThreshold"
    if rows.nbytes < LOCAL_BYTES:
        return spark.createDataFrame(rows, schema)
    was = spark.conf.get(key, None)
    spark.conf.set(key, "0b")
    try:
        return spark.createDataFrame(rows, schema)
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def broadcast_limit(spark: SparkSession, most: int = 64 << 20) -> int:
    """Bytes up to which a checked side may be broadcast."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return min(most, int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(raw)))
