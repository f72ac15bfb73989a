"""Result tables: per-run idempotent writes and scans of whatever runs exist.

Instead of rewriting every result CSV after each run, each run owns one
partition ``model/setting/train_dataset/test_dataset/seed`` of a Parquet
dataset written with dynamic partition overwrite: re-running a run replaces
exactly its partition, a lost task re-writes the same files, and readers see
only finished partitions. Runs or models that never finished are simply
absent from the scan; partition columns prune reads by model and setting.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_name

RUN_PARTITIONS = ["model_key", "setting", "train_dataset", "test_dataset", "seed"]


def save_runs(df: DataFrame, path: str) -> None:
    """A10: write result or instance rows, replacing only the partitions of the runs present in ``df``."""
    out = df.withColumn("model_key", safe_name("model"))  # A11: '/'-free partition value
    (
        out.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_PARTITIONS)
        .parquet(path)
    )


def load_runs(spark: SparkSession, path: str, models=None, settings=None) -> DataFrame:
    """Scan the finished runs; ``models``/``settings`` filters prune partitions."""
    df = spark.read.option("basePath", path).parquet(path)
    if models is not None:
        df = df.where(F.col("model_key").isin(*[m.replace("/", "_") for m in models]))
    if settings is not None:
        df = df.where(F.col("setting").isin(*settings))
    return df.drop("model_key")


RUN_KEYS = ["setting", "variant", "train_dataset", "test_dataset", "model", "seed"]


class RunStore:
    """Result rows of many runs under one folder, written by several jobs at once and read as whole runs only.

    A write goes to a folder of its own, which nobody reads (``stage``). It counts from the moment its entry
    ``commits/<number>`` exists (``commit``): the file system creates an entry only if it is not there, so two writers
    that reach for one number get two, and a job that dies before has left nothing to see. A run is given by its key
    columns, as values: names need no folder-safe form and cannot collide. A run that several commits hold is read
    from the last one. Rows without a key value are runs of their own null key.

    Needs a file system whose create-if-absent is atomic (HDFS, local); one entry is a few bytes, one per commit.
    """

    def __init__(self, spark: SparkSession, path: str, keys=RUN_KEYS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def stage(self, df: DataFrame) -> str:
        """Write rows without showing them; the name of the write."""
        write = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/write_id={write}")
        return write

    def commits(self) -> list[tuple[int, str]]:
        """(number, write) of every commit, in order."""
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/commits/*")) or []
        names = sorted(f.getPath().getName() for f in found)
        out = []
        for name in names:
            stream = self._fs.open(self._hadoop.Path(f"{self.path}/commits/{name}"))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if len(text) == 32:  # an entry that is still empty is not there yet
                out.append((int(name), text))
        return out

    def commit(self, write: str) -> int:
        """Show a staged write; the commit's number."""
        number = 0
        found = self._fs.globStatus(self._hadoop.Path(f"{self.path}/commits/*")) or []
        number = max((int(f.getPath().getName()) for f in found), default=-1) + 1
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/commits"))
        while True:
            entry = self._hadoop.Path(f"{self.path}/commits/{number:09}")
            stream = self._create(entry)
            if stream is None:
                number += 1  # another writer was first
                continue
            stream.write(write.encode())
            stream.close()
            return number

    def _create(self, entry):
        """A stream to a new entry, or None where the entry exists."""
        if self._fs.getUri().getScheme() == "file":
            # Hadoop's local file system looks first and creates then; the operating system does both at once
            new = self.spark._jvm.java.io.File(entry.toUri().getPath()).createNewFile()
            return self._fs.create(entry, True) if new else None
        try:
            return self._fs.create(entry, False)
        except Py4JJavaError:
            if not self._fs.exists(entry):
                raise
            return None

    def save(self, df: DataFrame) -> int:
        """A10: the rows of finished runs; a run that is saved again is replaced as a whole."""
        return self.commit(self.stage(df))

    def load(self, models=None, settings=None) -> DataFrame:
        """The newest rows of every committed run. An empty store is an error, as a missing file is."""
        done = self.commits()
        if not done:
            raise FileNotFoundError(f"no committed run under {self.path}")
        order = self.spark.createDataFrame([(w, n) for n, w in done], "write_id string, commit_no int")
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/write_id={w}" for w in dict.fromkeys(w for _, w in done)])
        if models is not None:
            rows = rows.where(F.col("model").isin(*models))
        if settings is not None:
            rows = rows.where(F.col("setting").isin(*settings))
        rows = rows.join(F.broadcast(order), "write_id")
        newest = rows.groupBy(*self.keys).agg(F.max("commit_no").alias("newest"))
        left, right = rows.alias("r"), newest.alias("n")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        on = F.col("r.commit_no") == F.col("n.newest")
        for c in same:
            on = on & c
        return left.join(right, on, "left_semi").drop("write_id", "commit_no")
