"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``; where that is unset, a temporary
    folder is made and set as checkpoint folder if Spark runs on one machine
    (tests), and on a cluster this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the driver ends, after a failure too."""
    found = f"{shared_dir(spark)}/blockloom/{spark.sparkContext.applicationId}"
    if found not in _marked:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(found)
    return found


def discard(spark: SparkSession) -> None:
    """Delete at once all that this application wrote; its earlier results can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path of this application's that is not in use."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back: lineage ends there.

    Results are lazy and read these tables, so they stay until ``discard`` or the driver's end.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
