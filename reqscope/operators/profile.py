"""Dataset profiling: lengths, class balance, summary, length histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HIST_BINS
from ..functions.text import char_len, word_len


def with_lengths(df: DataFrame, text: str = "requirement_text") -> DataFrame:
    """H1/H2: add ``char_len`` and ``word_len``."""
    return df.withColumns({"char_len": char_len(text), "word_len": word_len(text)})


def class_counts(df: DataFrame, by: str = "dataset", label: str = "label") -> DataFrame:
    """Rows per (dataset, label) and their share of all rows of the dataset.

    The share's denominator counts every row, labels outside {0, 1} included.
    The window runs over the aggregated table (datasets x labels rows) only.
    """
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("share", F.coalesce(F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)))


def eda_summary(df: DataFrame, by: str = "dataset", text: str = "requirement_text", label: str = "label") -> DataFrame:
    """One row per dataset in a single aggregation pass."""
    lab = F.col(label)
    total = F.count(F.lit(1))
    return df.groupBy(by).agg(
        total.alias("total"),
        F.count_if(lab == 0).alias("clear_0"),
        F.count_if(lab == 1).alias("ambiguous_1"),
        F.coalesce(F.count_if(lab == 0) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("pct_clear"),
        F.coalesce(F.count_if(lab == 1) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("pct_ambiguous"),
        F.avg(word_len(text)).alias("avg_words"),
        F.avg(char_len(text)).alias("avg_chars"),
    )


def length_histogram(
    df: DataFrame,
    by: str = "dataset",
    label: str = "label",
    cols: tuple[str, ...] = ("word_len", "char_len"),
    bins: int = HIST_BINS,
) -> DataFrame:
    """Equal-width histogram per (dataset, class, column), each class over its own range.

    One pass over the rows counts distinct values; ranges, bins and counts all
    come from that small table. Edges are ``lo + k * (hi - lo) / bins`` (the
    last one ``hi``). A value goes to the bin its scaled position says, moved
    by one where the rounded edges say otherwise; the last bin holds its upper
    edge too. Empty bins are emitted; a constant column uses [v - 0.5, v + 0.5].
    """
    keys = [by, label, "col"]
    values = (
        df.where(F.col(label).isin(0, 1))
        .select(by, label, *cols)
        .unpivot([by, label], list(cols), "col", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*keys, F.col("value").cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # groups are datasets x classes x columns; each gathers its distinct lengths only
    groups = values.groupBy(*keys).agg(
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.collect_list(F.struct("value", "n")).alias("values"))
    same = F.col("vmin") == F.col("vmax")
    groups = groups.select(
        *keys, "values", F.when(same, F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
        F.when(same, F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    edge = lambda k: F.when(k == bins, F.col("hi")).otherwise(k * width + F.col("lo"))
    rows = groups.select(*keys, "lo", "hi", F.explode("values").alias("v")).select(*keys, "lo", "hi", "v.*")
    first = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
    rows = rows.withColumn("b", first).withColumn("b", F.when(F.col("value") < edge(F.col("b")), F.col("b") - 1).otherwise(F.col("b")))
    rows = rows.withColumn(
        "bin", F.when((F.col("value") >= edge(F.col("b") + 1)) & (F.col("b") < bins - 1), F.col("b") + 1).otherwise(F.col("b")))
    counts = rows.groupBy(*keys, "bin").agg(F.sum("n").alias("cnt"))
    skeleton = groups.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return skeleton.join(counts, keys + ["bin"], "left").select(
        *keys,
        "bin",
        edge(F.col("bin")).alias("bin_lo"),
        edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce(F.col("cnt"), F.lit(0)).cast("bigint").alias("count"),
    )
