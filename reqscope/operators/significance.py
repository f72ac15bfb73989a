"""Paired significance tests across seeds.

Shape of both tests: collapse to one value per (setting, seed, model)
(D10a), pivot models into columns (one row per setting and seed), explode a
fixed list of model pairs, then aggregate per (setting, pair). No self-join
of data rows is needed; the pair count is bounded by the model list, and
the per-pair group size is bounded by the number of seeds.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ALPHA, ENCODER_ORDER, ENCODER_SHORT_NAMES, KEY3, SIGNIFICANCE_SETTINGS
from ..functions.stats import normal_two_sided_p, signed_rank_p, t_two_sided_p
from ..functions.text import fixed3, pvalue_text, yes_no


def per_seed_values(results: DataFrame, metric: str, model_col: str = "model", keys=KEY3, unique: bool = False) -> DataFrame:
    """Mean of ``metric`` per (keys, seed, model); rows with NULL keys/seed/value dropped.

    ``unique`` asserts that there is one value each: a repeated one is an error,
    raised when the result is computed.
    """
    found = (
        results.na.drop(subset=list(keys) + ["seed", model_col, metric])
        .groupBy(*keys, "seed", model_col)
        .agg(F.avg(metric).alias("v"), F.count(F.lit(1)).alias("n_values"))
    )
    if unique:
        twice = F.raise_error(F.concat(F.lit("more than one value for "), F.concat_ws(", ", *keys, "seed", model_col)))
        found = found.withColumn("v", F.when(F.col("n_values") > 1, twice.cast("double")).otherwise(F.col("v")))
    return found.drop("n_values")


def paired_differences(values: DataFrame, pairs: list[tuple[str, str]], model_col: str = "model", keys=KEY3) -> DataFrame:
    """One row per (keys, seed, pair) where both models have a value."""
    models = sorted({m for p in pairs for m in p})
    wide = values.groupBy(*keys, "seed").pivot(model_col, models).agg(F.first("v"))
    cells = F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}`").alias("a"), F.col(f"`{b}`").alias("b"))
        for a, b in pairs
    ])
    return (
        wide.select(*keys, "seed", F.inline(cells))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn("d", F.col("a") - F.col("b"))
    )


def sorted_pairs(models) -> list[tuple[str, str]]:
    """Each unordered pair once, i < j in code-point order of the names."""
    return list(combinations(sorted(set(models)), 2))


def paired_t_tests(results: DataFrame, metric: str = "f1", models=None) -> DataFrame:
    """Two-sided paired t-test per (setting, model pair) over seeds; pairs with n < 2 skipped.

    ``models`` defaults to the distinct models of ``results`` (a small,
    bounded list, like the value list a pivot collects).
    """
    if models is None:
        models = [r[0] for r in results.select("model").where(F.col("model").isNotNull()).distinct().collect()]
    diffs = paired_differences(per_seed_values(results, metric), sorted_pairs(models))
    agg = diffs.groupBy(*KEY3, "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg("d").alias("mean_d"),
        F.stddev_samp("d").alias("sd_d"),
        F.min("d").alias("min_d"),
        F.max("d").alias("max_d"),
    ).where(F.col("n_pairs") >= 2)
    t = F.col("mean_d") / (F.col("sd_d") / F.sqrt(F.col("n_pairs").cast("double")))
    p = (
        F.when(F.col("min_d") == F.col("max_d"), F.when(F.col("mean_d") != 0, F.lit(0.0)))
        .otherwise(t_two_sided_p(t, F.col("n_pairs") - 1))
    )
    return agg.select(*KEY3, F.lit(metric).alias("metric"), "model_a", "model_b", "n_pairs", "mean_a", "mean_b", p.alias("pvalue"))


def _settings_skeleton(df: DataFrame, pairs) -> DataFrame:
    """The fixed settings x pairs grid (literal array, exploded: no join needed)."""
    cells = [
        F.struct(
            F.lit(s).alias("setting"), F.lit(tr).alias("train_dataset"), F.lit(te).alias("test_dataset"),
            F.lit(label).alias("setting_label"), F.lit(si).alias("setting_order"),
            F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.lit(pi).alias("pair_order"),
        )
        for si, (s, tr, te, label) in enumerate(SIGNIFICANCE_SETTINGS)
        for pi, (a, b) in enumerate(pairs)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*cells)))


def with_short_names(results: DataFrame, short_names=ENCODER_SHORT_NAMES) -> DataFrame:
    """Results keyed by short display names (fixed mapping, broadcast)."""
    dim = results.sparkSession.createDataFrame(list((v, k) for k, v in short_names.items()), "model string, short string")
    return results.join(F.broadcast(dim), "model").drop("model").withColumnRenamed("short", "model")


def wilcoxon_tests(results: DataFrame, metric: str = "f1", order=ENCODER_ORDER, force_normal: bool = False) -> DataFrame:
    """Wilcoxon signed-rank tests for listed pairs in listed order, all settings.

    ``results`` carries ``model`` already mapped to the listed names, one value
    per (setting, seed, model). Zero differences are dropped (``n_pairs`` counts
    them), mid-ranks of |d| come from two windows over the (setting, pair)
    group (a row per seed), stat = min(W+, W-). The p-value is exact whatever
    the number of pairs and ties; ``force_normal`` asks for the normal form
    with tie correction. ``method`` records which.
    """
    pairs = list(combinations(order, 2))
    diffs = paired_differences(per_seed_values(results, metric, unique=True), pairs)
    grp = KEY3 + ["model_a", "model_b"]
    # zero differences get their own window partition, so ranks cover non-zero |d| only
    part = grp + ["nz"]
    ranked = (
        diffs.withColumn("nz", F.col("d") != 0)
        .withColumn("ad", F.abs("d"))
        .withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*part, "ad")))
        .withColumn("r2", (2 * F.rank().over(Window.partitionBy(*part).orderBy("ad")) + F.col("t") - 1).cast("int"))
    )
    nzc = F.col("nz")
    stats = ranked.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.max("ad").alias("max_abs_d"),
        F.count_if(nzc).alias("m"),
        F.sum(F.when(F.col("d") > 0, F.col("r2")).otherwise(0)).alias("plus2"),
        F.sum(F.when(F.col("d") < 0, F.col("r2")).otherwise(0)).alias("minus2"),
        # tie term sum(t^3 - t): a value tied t times contributes (t^2 - 1) on each of its t rows
        F.sum(F.when(nzc, F.col("t") * F.col("t") - 1).otherwise(0)).alias("tie_term"),
        F.collect_list(F.when(nzc, F.col("r2"))).alias("ranks2"),  # a rank per seed
    )
    m, stat2 = F.col("m"), F.least("plus2", "minus2")
    mean_w = m * (m + 1) / 4.0
    var_w = m * (m + 1) * (2 * m + 1) / 24.0 - F.col("tie_term") / 48.0
    z = (stat2 / 2.0 - mean_w) / F.nullif(F.sqrt(var_w), F.lit(0.0))
    p = normal_two_sided_p(z) if force_normal else signed_rank_p("ranks2", stat2)
    tested = stats.select(
        *grp, "n_pairs", "mean_a", "mean_b", "max_abs_d", (stat2 / 2.0).alias("stat"),
        F.when(m > 0, F.lit("normal" if force_normal else "exact")).alias("method"), F.when(m > 0, p).alias("p"))

    skel = _settings_skeleton(results, pairs)
    j = skel.join(tested, grp, "left")
    n = F.coalesce(F.col("n_pairs"), F.lit(0)).cast("bigint")
    insufficient = n < 2
    identical = F.col("max_abs_d") <= 1e-8
    status = F.when(insufficient, F.lit("insufficient_pairs")).when(identical, F.lit("identical_values")).otherwise(F.lit("ok"))
    stat_out = F.when(insufficient, F.lit(None).cast("double")).when(identical, F.lit(0.0)).otherwise(F.col("stat"))
    p_out = F.when(insufficient, F.lit(None).cast("double")).when(identical, F.lit(1.0)).otherwise(F.col("p"))
    method_out = F.when(insufficient | identical, F.lit(None).cast("string")).otherwise(F.col("method"))
    return j.select(
        *KEY3, "setting_label", F.lit(metric).alias("metric"), "model_a", "model_b", n.alias("n_pairs"),
        "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("mean_diff_a_minus_b"),
        stat_out.alias("wilcoxon_statistic"), p_out.alias("pvalue"),
        F.coalesce(p_out < ALPHA, F.lit(False)).alias("significant_0_05"),
        status.alias("status"), method_out.alias("method"), "setting_order", "pair_order",
    )


def significance_table(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """E6 + H8/H9: the cross-tab content (comparison, mean A/B, p text, Yes/No) in listed order."""
    return tests.select(
        "setting_order", "pair_order", "setting_label",
        F.concat_ws(" vs. ", "model_a", "model_b").alias("comparison"),
        F.concat(fixed3("mean_a"), F.lit("/"), fixed3("mean_b")).alias("mean_a_b"),
        pvalue_text("pvalue").alias("p_text"),
        yes_no("pvalue", alpha).alias("significant"),
    ).orderBy("setting_order", "pair_order")
