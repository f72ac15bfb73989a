"""Running evaluation over arriving prediction rows (K1).

Prediction rows (T3) land as files; a Structured Streaming query keeps the
four confusion counts per run and attempt as state (they add up, so no
watermark is needed) and, per micro-batch, writes a metrics snapshot to the
shared folder. A run that is delivered again carries a higher ``attempt``; the
snapshot shows the latest attempt of each run only, so a repeated run replaces
its counts and never adds to them (rows without an attempt are attempt 0).
Output mode ``complete`` makes every snapshot the whole result. Each batch has
a folder of its own (``epoch=N``), and readers take the newest finished one:
there is always a table to read, and a replayed batch rewrites its own folder.
The checkpoint location makes the query restartable.

The number of state partitions is fixed by the first run of a checkpoint. The
state holds one row per run and attempt, and runs are bounded by the experiment grid, not
by the data. Each micro-batch is partially aggregated before its shuffle, too.
So a small state partition count (``state_partitions``) avoids thousands of
near-empty state-store tasks per batch on a cluster with a large
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import METRICS
from ..functions.metrics import confusion_aggs, metric_columns
from ..operators.evaluate import RUN_KEYS

INSTANCE_SCHEMA = (
    "setting string, variant string, train_dataset string, test_dataset string, model string, "
    "seed int, req_id bigint, y_true int, y_pred int, attempt bigint"
)


def running_confusion(stream: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Streaming aggregate of confusion counts per run and attempt."""
    attempt = F.coalesce(F.col("attempt"), F.lit(0)).alias("attempt")
    return stream.groupBy(*keys, attempt).agg(*confusion_aggs(), F.count(F.lit(1)).alias("n"))


def metrics_snapshot(counts: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Batch projection of a counts snapshot into the run-results shape (T2): the latest attempt of each run."""
    cells = ["tn", "fp", "fn", "tp", "n"]
    last = counts.groupBy(*keys).agg(F.max_by(F.struct(*cells), "attempt").alias("c")).select(*keys, "c.*")
    return last.select(*keys, *metric_columns(), "tn", "fp", "fn", "tp", F.col("n").alias("n_test"))


def start(
    spark: SparkSession,
    source_dir: str,
    out_path: str,
    checkpoint: str,
    keys=RUN_KEYS,
    schema: str = INSTANCE_SCHEMA,
    files_per_trigger: int | None = None,
    available_now: bool = True,
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Start the running evaluation; ``available_now`` drains what has arrived and stops.

    ``state_partitions`` sets the shuffle partitions of this query only: the
    stream copies the session's conf when it starts, and the session's own
    value is restored right after.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    counts = running_confusion(reader.parquet(source_dir), keys)

    def write(batch: DataFrame, epoch_id: int) -> None:
        metrics_snapshot(batch, keys).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch_id}")
        # a reader may still hold the snapshot before; older ones go
        done = _finished(spark, out_path)
        for old in sorted(done)[:-2]:
            done[old].getFileSystem(spark._jsc.hadoopConfiguration()).delete(done[old], True)

    w = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    if not state_partitions:
        return w.start()
    key = "spark.sql.shuffle.partitions"
    prev = spark.conf.get(key)
    spark.conf.set(key, str(int(state_partitions)))
    try:
        return w.start()
    finally:
        spark.conf.set(key, prev)


def _finished(spark: SparkSession, out_path: str) -> dict:
    """Epoch -> folder of the snapshots with a success mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/epoch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    folders = [f.getPath().getParent() for f in found]
    return {int(f.getName().partition("=")[2]): f for f in folders}


def read_snapshot(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest finished snapshot (the one with the highest epoch and a success mark)."""
    epochs = _finished(spark, out_path)
    if not epochs:
        raise FileNotFoundError(f"no finished snapshot under {out_path}")
    return spark.read.parquet(f"{out_path}/epoch={max(epochs)}")


__all__ = ["INSTANCE_SCHEMA", "METRICS", "running_confusion", "metrics_snapshot", "start", "read_snapshot"]
