"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share, from ``spark.checkpoint.dir``.

    Where nothing is set, a local session (as in tests) gets a temporary folder; executors on other machines
    would each have their own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and every executor share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vicinal-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no recomputation, and
    later joins see a table of known size whose exchanges adaptive execution can split."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop(table: DataFrame | None) -> None:
    """Remove a table that ``cut`` has written and that nothing unwritten comes from any more."""
    if table is not None and hasattr(table, "cut_path"):
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
