"""Session defaults and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestrata")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It is the one that ``spark.checkpoint.dir`` names; only where that is unset, as in tests on one
    machine, a temporary folder is made and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lodestrata-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _context_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext.getCheckpointDir()
    return os.path.dirname(found.rstrip("/")) if found else None


class Cuts:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table ends the lineage: lost executors cost a re-read, not a recomputation of all rounds.
    ``drop`` frees a table that no later plan reads; what is left goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_cut_path", None):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session is gone already
            if self.root.startswith("file://"):
                shutil.rmtree(self.root[7:], ignore_errors=True)

    def _delete(self, path: str) -> None:
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)
            return
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
