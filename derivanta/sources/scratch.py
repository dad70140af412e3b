"""Written tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is unset in local mode, as in a test, a new temporary folder is
    made, once a session, and set as the context's checkpoint folder; a cluster must name one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is unset: driver and executors need a shared folder")
    made = getattr(spark.sparkContext, "_derivanta_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(made)
        spark.sparkContext._derivanta_dir = made
    return made


class Scratch:
    """Written tables of one operator run. They cut the lineage: what follows reads files
    that outlive any executor. drop() removes a table once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.delete(t._scratch_path)

    def clear(self) -> None:
        """Removes all tables of the run."""
        self.delete(self.root)

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
