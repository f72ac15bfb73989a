"""Best-checkpoint choice with early-stopping patience over an epoch log.

Input: (run_id, epoch, val_f1). Epoch e improves when its score is strictly
above the best of all earlier epochs (start -1.0; NULL/NaN never improves).
Bad epochs since the last improvement are counted with a running
"streak id" = number of improvements so far; training stops at the first
epoch whose bad count reaches ``patience``. The best epoch is the last
improving epoch at or before the stop. All of this is window functions
partitioned by run: a run's epochs are few (bounded by the epoch budget).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_checkpoint(log: DataFrame, run: str = "run_id", epoch: str = "epoch", score: str = "val_f1", patience: int = 2) -> DataFrame:
    """(run_id, best_epoch, best_val_f1, stop_epoch, epochs_run, stopped_early)."""
    w = Window.partitionBy(run).orderBy(epoch)
    prior_best = F.coalesce(
        F.max(F.when(~F.isnan(score), F.col(score))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0)
    )
    s = F.col(score)
    improved = s.isNotNull() & ~F.isnan(s) & (s > prior_best)
    df = log.withColumn("_imp", improved)
    df = df.withColumn("_streak", F.sum(F.col("_imp").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn(
        "_bad",
        F.when(F.col("_imp"), F.lit(0)).otherwise(
            F.row_number().over(Window.partitionBy(run, "_streak").orderBy(epoch)) - F.when(F.col("_streak") > 0, 1).otherwise(0)
        ),
    )
    stop = df.groupBy(run).agg(
        F.min(F.when(F.col("_bad") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.max(epoch).alias("last_epoch"),
    )
    j = df.join(stop, run)
    ran = j.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return ran.groupBy(run).agg(
        F.max_by(F.when(F.col("_imp"), F.col(epoch)), F.when(F.col("_imp"), F.col(epoch))).alias("best_epoch"),
        F.max_by(F.when(F.col("_imp"), F.col(score)), F.when(F.col("_imp"), F.col(epoch))).alias("best_val_f1"),
        F.first("stop_epoch").alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
        F.first(F.col("stop_epoch").isNotNull()).alias("stopped_early"),
    )
