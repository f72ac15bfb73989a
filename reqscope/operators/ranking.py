"""Multi-seed summaries, rankings and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DISPLAY_NAME, KEY3, KEY4, METRICS, MODEL_ORDER

ORDERED_COLS = KEY4 + ["model_display"] + [f"{m}_{s}" for m in METRICS for s in ("mean", "std")]


def summarize(results: DataFrame, keys=KEY4, metrics=METRICS) -> DataFrame:
    """Mean and sample std of each metric per group (NULL keys kept, NULL metrics skipped)."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]  # B7 names
    return results.groupBy(*keys).agg(*aggs)


def original_only(df: DataFrame) -> DataFrame:
    """B2."""
    return df.where(F.col("variant") == "original")


def top_k(summary: DataFrame, keys=KEY3, k: int = 3, metric: str = "f1_mean") -> DataFrame:
    """The k best models per group by ``metric`` (NULL last, ties by model); NULL-key rows dropped."""
    w = Window.partitionBy(*keys).orderBy(F.col(metric).desc_nulls_last(), F.col("model"))
    return (
        summary.na.drop(subset=list(keys))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def model_dim(spark: SparkSession) -> DataFrame:
    """Fixed model dimension (order index, display name): bounded by construction."""
    rows = [(m, i, DISPLAY_NAME.get(m, m)) for i, m in enumerate(MODEL_ORDER)]
    return spark.createDataFrame(rows, "model string, model_order int, display string")


def with_display(df: DataFrame) -> DataFrame:
    """Display name and order index with fallback to the raw name (broadcast of a fixed dim)."""
    dim = model_dim(df.sparkSession)
    return (
        df.join(F.broadcast(dim), "model", "left")
        .withColumn("model_display", F.coalesce(F.col("display"), F.col("model")))
        .drop("display")
    )


def union_all(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by name, columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def paper_summary(classical_summary: DataFrame, *other_summaries: DataFrame) -> DataFrame:
    """Unified summary, fixed column order (B6) + ``model_order``, ordered by group and f1_mean."""
    df = with_display(union_all(classical_summary, *other_summaries))
    cols = [c for c in ORDERED_COLS if c in df.columns] + ["model_order"]
    return df.select(*cols).orderBy(*KEY3, F.col("f1_mean").desc_nulls_last(), F.col("model"))


def filter_models(df: DataFrame, models) -> DataFrame:
    """Keep listed models (a fixed, bounded list)."""
    return df.where(F.col("model").isin(*models))


def metric_bars(summary: DataFrame, keys=KEY3, metrics=("f1", "mcc", "cohen_kappa")) -> DataFrame:
    """Long (metric, mean, std) rows behind the bar charts, F2 order inside each group."""
    stack = ", ".join(f"'{m}', {m}_mean, {m}_std" for m in metrics)
    long = summary.select(*keys, "model", F.expr(f"stack({len(metrics)}, {stack}) AS (metric, mean, std)"))
    return long.orderBy(*keys, "metric", F.col("mean").desc_nulls_last(), "model")


def reason_pivot(reason_perf: DataFrame, keys=KEY3, value: str = "f1") -> DataFrame:
    """Reason x model matrix of one metric, a column for each model that is there.

    Models in their fixed order come first, others after them by name; the list
    of distinct names (a row per model) goes to the driver, as in any pivot.
    Two values for one cell are an error, raised when the result is computed.
    """
    cell = [*keys, "reason", "model_display", "model_order"]
    once = with_display(reason_perf).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("v"))
    twice = F.raise_error(F.concat(F.lit("two values for one cell of the reason matrix: "), F.concat_ws(", ", *keys, "reason", "model_display")))
    once = once.withColumn("v", F.when(F.col("n") > 1, twice.cast("double")).otherwise(F.col("v")))
    found = with_display(reason_perf.select("model").distinct()).select("model_display", "model_order").distinct().collect()
    names = [r[0] for r in sorted(found, key=lambda r: (r[1] is None, r[1] or 0, r[0] or "")) if r[0] is not None]
    return once.groupBy(*keys, "reason").pivot("model_display", names).agg(F.max("v"))
