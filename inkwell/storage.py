"""Tables that cut lineage, kept in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all its tasks run in one machine, as in local tests.
LOCAL_DEFAULT = "/tmp/checkpoints/inkwell"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, the local default of a local master.

    On a cluster a machine's own folder would hold a part of each table only, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL_DEFAULT).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back.

    The files outlive lost executors, so later stages never recompute what stands before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ink_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_ink_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes from which a source is worth dealing out.
LEAST_SPREAD = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to more tasks where its source has fewer pieces than there are cores, as a file of one row group has.

    Larger sources are left as they are, so nothing is shuffled where it would count, and so are tiny ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(4 * cores) if size >= LEAST_SPREAD and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
