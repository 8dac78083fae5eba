"""Tables and files that the driver and every executor can see.

All of them live under ``spark.checkpoint.dir``.  The folder is read from the
session; only where it is unset and the master is local (tests, a laptop) is one
made and set.  On a cluster a folder of one machine would lose what executors
write, so there an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one set here where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="watchfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder of written tables; what is no longer read is dropped at once, the rest by ``release`` or at exit."""

    live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        if not self.live:
            atexit.register(release)
        self.live.append(self)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it again: the lineage ends at files that outlive any executor."""
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # the session may be gone already
            if self.path.startswith("file://"):
                shutil.rmtree(self.path.removeprefix("file://"), ignore_errors=True)


def release_unread(made: list[Scratch], df: DataFrame) -> None:
    """Drop those of the scratch tables whose files ``df`` doesn't read, and take them off the list."""
    files = df.inputFiles() if made else []
    for scratch in [s for s in made if not any(s.path.rsplit("/", 1)[1] in f.split("/") for f in files)]:
        made.remove(scratch)
        if scratch in Scratch.live:
            Scratch.live.remove(scratch)
            scratch.close()


def release() -> None:
    """Drop all scratch tables; for a long session, once the results that rest on them are written or no longer wanted."""
    while Scratch.live:
        Scratch.live.pop().close()
