"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back, so a lost executor costs a re-read and
never a recomputation of all rounds. The folder is the session's ``spark.checkpoint.dir``; only where that is unset
(tests, notebooks on one machine) a folder of our own is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a local one if none is set."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


class Workspace:
    """Tables of one operator run under the shared folder, deleted when dropped or when the JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
        path = self._path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and return the frame that reads it."""
        at = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def put_counted(self, df: DataFrame, name: str, condition: str = "true") -> tuple[DataFrame, int]:
        """Write a table and count the rows that meet a condition in the same pass."""
        seen = Observation(name)
        out = self.put(df.observe(seen, F.count_if(F.expr(condition)).alias("n")), name)
        return out, int(seen.get["n"])

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
