"""Cutting lineage: tables under the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a local one, but only under a local master: on a
    cluster every executor would write to a disk of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='sparkmine-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/sparkmine-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: lineage ends there, and lost executors lose nothing."""
    folder = folder or new_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", codec).parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table.__dict__["_cut_folder"] = folder
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() returned and nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.__dict__["_cut_folder"])
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


