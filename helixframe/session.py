"""Session helpers shared by every module: shared scratch storage and table reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent a local folder is made, which is only right
    when driver and executors are one process (local mode); elsewhere this raises.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("helixframe.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, local, True)
        base = "file://" + local
        spark.conf.set("helixframe.scratch.dir", base)
    return base.rstrip("/")


_open: list[Scratch] = []


def release() -> None:
    """Delete the scratch tables of all queries so far; call it when their results have been written or collected."""
    while _open:
        _open.pop().clear()


class Scratch:
    """Tables written under the shared folder, to cut lineage and to be read more than once.

    A result is read lazily from them, so they stay until release() or the end of the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/helixframe-{uuid.uuid4().hex}"
        if not _open:
            atexit.unregister(release)
            atexit.register(release)  # after the context's own, so that it runs before the context ends
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it back; the shuffles that made it can then go."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()  # lets the context cleaner remove shuffle files of the finished write
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        self._drop(self.root)

    def drop(self, name: str) -> None:
        self._drop(f"{self.root}/{name}")

    def _drop(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        try:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the gateway is gone at interpreter exit
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
