"""Reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may be without and gets a folder of its own."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-"))
    return context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and go on from it: the lineage ends there, and lost executors lose nothing.

    checkpoint() would also carry on the estimates of size, which multiply from join to join until, after some dozen steps,
    planning takes longer than running; a table has its own size. It is deleted at the end of the application or by drop().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    path_of(spark, path)[1].deleteOnExit(path_of(spark, path)[0])
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *cuts: DataFrame) -> None:
    """Delete tables of cut() that nothing will read any more."""
    for df in cuts:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path, system = path_of(spark, folder)
            system.delete(path, True)


def path_of(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
