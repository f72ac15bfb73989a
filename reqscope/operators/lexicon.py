"""Trigger lexicon and reasons: match, mask, remove, variant fan-out, reason counts (H3-H5, H14, G3u, D8a, D9a, F1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import TOP_N_REASONS
from ..functions.text import mask_triggers, parse_reasons, remove_triggers, trigger_hits

VARIANT_NAMES = ("original", "masked_triggers", "removed_triggers")


def with_reasons(df: DataFrame, text: str = "requirement_text", out: str = "reasons") -> DataFrame:
    """Comma list of matched terms in lexicon order, NULL when none match."""
    hits = trigger_hits(text)
    return df.withColumn(out, F.when(F.size(hits) > 0, F.array_join(hits, ",")))


def trigger_matches(df: DataFrame, key: str = "req_id", text: str = "requirement_text") -> DataFrame:
    """H14, exploded: one (key, term) row per matched term."""
    return df.select(key, F.explode(trigger_hits(text)).alias("term"))


def text_variants(df: DataFrame, text: str = "requirement_text") -> DataFrame:
    """G3u: one pass fan-out of each row into original / masked / removed text.

    ``text`` keeps the original; the text a model scores is ``scored_text``.
    """
    variants = F.array(
        F.struct(F.lit(VARIANT_NAMES[0]).alias("variant"), F.col(text).alias("scored_text")),
        F.struct(F.lit(VARIANT_NAMES[1]).alias("variant"), mask_triggers(text).alias("scored_text")),
        F.struct(F.lit(VARIANT_NAMES[2]).alias("variant"), remove_triggers(text).alias("scored_text")),
    )
    return df.withColumn("_v", F.explode(variants)).select("*", "_v.variant", "_v.scored_text").drop("_v")


def reason_items(df: DataFrame, keys=("req_id",), reasons: str = "reasons", distinct: bool = False) -> DataFrame:
    """H3 exploded: (keys..., pos, reason); ``distinct`` keeps the first of repeated items."""
    items = parse_reasons(reasons)
    if distinct:
        items = F.array_distinct(items)
    return df.select(*keys, F.posexplode(items).alias("pos", "reason")).withColumn("pos", F.col("pos") + 1)


def reason_counts(df: DataFrame, by=("dataset",), reasons: str = "reasons") -> DataFrame:
    """Frequency of each reason; a repeat inside one row counts each time.

    Partial aggregation runs before the shuffle, so a hot reason costs one
    row per map task, not one row per occurrence.
    """
    return (
        df.select(*by, F.explode(parse_reasons(reasons)).alias("reason"))
        .groupBy(*by, "reason")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def distinct_reasons(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Sorted distinct reasons."""
    return df.select(F.explode(parse_reasons(reasons)).alias("reason")).distinct().orderBy("reason")


def top_reasons(counts: DataFrame, by=("dataset",), n: int = TOP_N_REASONS) -> DataFrame:
    """The ``n`` most frequent reasons per group (ties by reason ascending).

    Runs over the aggregated counts (one row per distinct reason), never over raw rows.
    """
    w = Window.partitionBy(*by).orderBy(F.col("cnt").desc(), F.col("reason"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
