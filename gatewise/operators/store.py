"""Tables that are written in the middle of a job: lineage ends there, and they are
read again as often as needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or a warehouse
    that the session names. Only a session on one machine may name neither."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        local = context.master == "local" or context.master.startswith("local[")
        if not local and not context.getConf().contains("spark.sql.warehouse.dir"):
            raise RuntimeError("no shared folder: set spark.checkpoint.dir or spark.sql.warehouse.dir")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


#: Spark's setting to delete a job's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str = "table", tidy: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again; ``tidy`` deletes the shuffle
    files of the job that wrote it, which otherwise stay for a while."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy and before is None:
            conf.unset(CLEANUP)
        elif tidy:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        place.getFileSystem(conf).delete(place, True)
