"""Session helpers: local test sessions, checkpoint folder, written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "reqscope") -> SparkSession:
    """Session for tests and local benches (no UI, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REQSCOPE_DRIVER_MEMORY", "8g"))
        .config("reqscope.spread", "on")  # driver tables are single files
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; without it this raises, because executors cannot share a folder of one
    machine. Only a local master (tests) gets a scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a SparkContext handle (e.g. Spark Connect)
        if not conf_dir:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="reqscope-ckpt-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/tables/{name}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Columnar and compressed (faster than an RDD checkpoint of rows), and the
    files outlive any executor, so later stages never recompute the lineage.
    """
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table of the checkpoint folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, keys: list[str], name: str = "t") -> DataFrame:
    """Write ``df``, which holds all rows of a key in one partition of ``spark.sql.shuffle.partitions``, as a bucketed table in the checkpoint folder and read it back.

    Joins and groupings by ``keys`` that follow do not shuffle it. The table is external: the catalog of the session has only its name.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).sortBy(*keys).option("path", shared_path(spark, table)).saveAsTable(table, format="parquet")
    return spark.table(table)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition by ``keys`` where the session asks for it (``reqscope.spread`` = ``on``); off by default.

    Meant for small single-file tables on one machine, whose scan is one task.
    It never depends on the data's size: a cluster that does not set it never
    shuffles texts for this.
    """
    if df.sparkSession.conf.get("reqscope.spread", "off") != "on":
        return df
    return df.repartition(*keys)
