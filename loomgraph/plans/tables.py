"""Tables in the folder that driver and executors share: cut lineages, survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local temporary folder only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (one part for each value of column ``by``) and read it back; it goes when it is
    discarded, or when the session's file system is closed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As ``materialise``, with the number of rows, which is observed while they are written: no job of its own."""
    rows = Observation()
    out = materialise(df.observe(rows, F.count(F.lit(1)).alias("n")), name)
    return out, rows.get["n"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``materialise`` that nothing reads any more: what was made of them must be written itself."""
    for table in tables:
        spark = table.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
