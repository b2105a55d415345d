"""Reading the tables of a data directory and cutting long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; zone-less timestamps become UTC timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is what the session names in ``spark.checkpoint.dir``. Only where nothing is named
    and the session runs in one process (tests) a temporary folder is made and set.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame, drop: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.

    Unlike a local checkpoint the copy outlives any executor, and as a Parquet table it has
    a known size, by which Spark decides whether a join may broadcast it. ``drop`` is an
    earlier result of this function that is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if drop is not None and getattr(drop, "_cut_path", None):
        remove(drop)
    return out


def remove(df: DataFrame) -> None:
    """Delete the files behind a result of :func:`cut`."""
    remove_path(df.sparkSession, df._cut_path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
