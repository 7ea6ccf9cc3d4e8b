"""Cut long plans with tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint directory.

    Without that setting, as in tests, a local temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/emberframe-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result and go on from the written table.

    For results that several later steps read: they then share one computation
    and a known size, and a lost executor costs no recomputation of what came before.
    """
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Generations:
    """A table that is made anew round by round: each round is a written folder, and the one before it goes.

    A round may read the round before; once it is written, nothing reads that one any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder: str | None = None

    def put(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark)
        df.write.parquet(folder)
        if self.folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folder = folder
        return self.spark.read.schema(df.schema).parquet(folder)
