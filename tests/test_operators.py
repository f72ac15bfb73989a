"""Operator behaviour on small literal tables (split sizes, histogram, Wilcoxon branches, early stopping, per-reason)."""

import pytest
from pyspark.sql import functions as F

from reqscope.operators import evaluate, lexicon, profile, ranking, significance, split, training_log


def test_class_quotas_exact(spark):
    rows = [(i, "D", 1 if i < 58 else 0) for i in range(399)]
    df = spark.createDataFrame(rows, "req_id long, dataset string, label int")
    q = {r["label"]: r["test_c"] for r in split.class_quotas(df, ["dataset"]).collect()}
    assert q == {1: 12, 0: 68}


def test_split_disjoint_cover_and_sizes(spark):
    rows = [(i, "A" if i % 3 else "B", 1 if i % 7 == 0 else 0) for i in range(500)]
    df = spark.createDataFrame(rows, "req_id long, dataset string, label int")
    s = split.intra_split(df, seeds=[13, 42])
    assert s.count() == 1000
    assert s.select("seed", "req_id").distinct().count() == 1000
    quotas = split.class_quotas(split.with_seeds(df, [13, 42]), ["seed", "dataset"]).collect()
    got = {(r["seed"], r["dataset"], r["label"]): r["n"] for r in
           s.where(F.col("part") == "test").groupBy("seed", "dataset", "label").agg(F.count("*").alias("n")).collect()}
    for q in quotas:
        assert got.get((q["seed"], q["dataset"], q["label"]), 0) == q["test_c"]


def test_split_bucketed_equals_row_number(spark):
    """The bucketed boundary split picks exactly the first test_c rows in (md5, key) order."""
    rows = [(i, "A", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "req_id long, dataset string, label int")
    a = split.stratified_split(split.with_seeds(df, [7]), ["dataset"], bucket_digits=1)
    b = split.stratified_split(split.with_seeds(df, [7]), ["dataset"], bucket_digits=5)
    key = lambda d: sorted((r["req_id"], r["part"]) for r in d.collect())
    assert key(a) == key(b)


def test_histogram_edges(spark):
    df = spark.createDataFrame([("D", 0, v) for v in [0, 1, 2, 3]] + [("D", 1, 5) for _ in range(3)],
                               "dataset string, label int, x int")
    h = profile.length_histogram(df, cols=("x",), bins=3).orderBy("label", "bin").collect()
    assert [r["count"] for r in h if r["label"] == 0] == [1, 1, 2]
    ones = [r for r in h if r["label"] == 1]
    assert [r["count"] for r in ones] == [0, 3, 0]
    assert ones[0]["bin_lo"] == pytest.approx(4.5) and ones[-1]["bin_hi"] == pytest.approx(5.5)


def _results(spark, rows):
    return spark.createDataFrame(rows, "setting string, train_dataset string, test_dataset string, model string, seed int, f1 double")


def test_wilcoxon_branches(spark):
    s = ("intra", "PURE", "PURE")
    rows = []
    for i, seed in enumerate([13, 21, 42, 87, 123]):
        rows += [(*s, "BERT", seed, 0.5 + 0.1 * i + 0.01 * (i + 1)), (*s, "RoBERTa", seed, 0.5 + 0.1 * i)]
        rows += [(*s, "DistilBERT", seed, 0.3), (*s, "ALBERT", seed, 0.3)]
    rows.append(("cross", "PURE", "UserStories", "BERT", 13, 0.4))
    rows.append(("cross", "PURE", "UserStories", "RoBERTa", 13, 0.5))
    out = significance.wilcoxon_tests(_results(spark, rows)).collect()
    assert len(out) == 24
    by = {(r["setting"], r["train_dataset"], r["model_a"], r["model_b"]): r for r in out}
    r = by[("intra", "PURE", "BERT", "RoBERTa")]
    assert (r["n_pairs"], r["wilcoxon_statistic"], r["pvalue"], r["status"], r["method"]) == (5, 0.0, 0.0625, "ok", "exact")
    assert r["significant_0_05"] is False
    r = by[("intra", "PURE", "DistilBERT", "ALBERT")]
    assert (r["wilcoxon_statistic"], r["pvalue"], r["status"]) == (0.0, 1.0, "identical_values")
    r = by[("cross", "PURE", "BERT", "RoBERTa")]
    assert (r["n_pairs"], r["pvalue"], r["status"]) == (1, None, "insufficient_pairs")
    assert r["mean_a"] == pytest.approx(0.4)
    r = by[("cross", "UserStories", "BERT", "RoBERTa")]
    assert (r["n_pairs"], r["status"], r["mean_a"]) == (0, "insufficient_pairs", None)


def test_wilcoxon_normal_branch(spark):
    s = ("intra", "PURE", "PURE")
    rows = []
    for i in range(20):
        rows += [(*s, "BERT", i, 1.0 + (i % 5)), (*s, "RoBERTa", i, 0.0)]
    out = significance.wilcoxon_tests(_results(spark, rows), force_normal=True).where(
        (F.col("model_a") == "BERT") & (F.col("model_b") == "RoBERTa") & (F.col("setting") == "intra") & (F.col("train_dataset") == "PURE")
    ).first()
    assert out["method"] == "normal"
    assert 0 < out["pvalue"] < 1e-3


def test_paired_t_constant_difference(spark):
    s = ("intra", "PURE", "PURE")
    rows = [(*s, "A", seed, 0.5, "original") for seed in range(5)] + [(*s, "B", seed, 0.4, "original") for seed in range(5)]
    rows += [(*s, "C", seed, 0.5, "original") for seed in range(5)]
    df = spark.createDataFrame(rows, "setting string, train_dataset string, test_dataset string, model string, seed int, f1 double, variant string")
    out = {(r["model_a"], r["model_b"]): r["pvalue"] for r in significance.paired_t_tests(df).collect()}
    assert out[("A", "B")] == 0.0
    assert out[("A", "C")] is None


def test_best_checkpoint(spark):
    log = spark.createDataFrame(
        [(1, e, v) for e, v in enumerate([0.50, 0.60, 0.55, 0.58, 0.90], 1)]
        + [(2, e, v) for e, v in enumerate([0.1, 0.2, 0.3, 0.4], 1)]
        + [(3, 1, None), (3, 2, 0.5), (3, 3, 0.5), (3, 4, 0.4)],
        "run_id int, epoch int, val_f1 double")
    out = {r["run_id"]: r for r in training_log.best_checkpoint(log).collect()}
    assert (out[1]["best_epoch"], out[1]["stop_epoch"], out[1]["epochs_run"]) == (2, 4, 4)
    assert (out[2]["best_epoch"], out[2]["stop_epoch"], out[2]["stopped_early"]) == (4, None, False)
    assert (out[3]["best_epoch"], out[3]["stop_epoch"]) == (2, 4)


def test_reason_distinct_vs_repeated(spark):
    df = spark.createDataFrame([("D", "a,a", 1, 1), ("D", "a, b", 1, 0)], "dataset string, reasons string, y_true int, y_pred int")
    counts = {r["reason"]: r["cnt"] for r in lexicon.reason_counts(df).collect()}
    assert counts == {"a": 3, "b": 1}
    perf = {r["reason"]: r["n"] for r in evaluate.reason_performance(df, keys=["dataset"]).collect()}
    assert perf == {"a": 2, "b": 1}


def test_variants_keep_row_count(spark):
    df = spark.createDataFrame([(1, "it may be fast"), (2, "plain")], "req_id long, requirement_text string")
    v = lexicon.text_variants(df)
    assert v.count() == 6
    got = {(r["req_id"], r["variant"]): r["scored_text"] for r in v.collect()}
    assert got[(1, "masked_triggers")] == "it [TRIGGER] be [TRIGGER]"
    assert got[(1, "removed_triggers")] == "it be"


def test_wilcoxon_zero_difference_is_exact(spark):
    s = ("intra", "PURE", "PURE")
    rows = []
    for i, seed in enumerate([13, 21, 42, 87, 123]):
        rows += [(*s, "BERT", seed, 0.5 + 0.1 * i + (0.0 if i == 0 else 0.01 * i)), (*s, "RoBERTa", seed, 0.5 + 0.1 * i)]
    r = significance.wilcoxon_tests(_results(spark, rows)).where(
        (F.col("setting") == "intra") & (F.col("train_dataset") == "PURE") & (F.col("model_a") == "BERT") & (F.col("model_b") == "RoBERTa")
    ).first()
    # one zero dropped: m = 4 positive differences, W- = 0 -> p = 2 / 16
    assert (r["n_pairs"], r["wilcoxon_statistic"], r["method"], r["status"]) == (5, 0.0, "exact", "ok")
    assert r["pvalue"] == 0.125


def test_quotas_of_huge_classes(spark):
    """Counts whose product exceeds 64 bits give exact quotas."""
    from reqscope.operators import split

    n = 5_000_000_000
    counts = spark.createDataFrame([("A", 0, n + 1), ("A", 1, n)], "dataset string, label int, n_c bigint")
    got = {r["label"]: r["test_c"] for r in split.quotas_from_counts(counts, ["dataset"]).collect()}
    total = 2 * n + 1
    n_train = total - -(-total // 5)
    floors = [c * n_train // total for c in (n + 1, n)]
    rems = [c * n_train % total for c in (n + 1, n)]
    need = n_train - sum(floors)
    order = sorted((0, 1), key=lambda k: (-rems[k], k))
    train = [floors[k] + (order.index(k) < need) for k in (0, 1)]
    assert got == {0: n + 1 - train[0], 1: n - train[1]}


def test_split_never_gathers_a_class(spark):
    """No exchange of rows is keyed on (seed, dataset, label) alone."""
    import re

    from reqscope.operators import split

    df = spark.range(1000).selectExpr("id as req_id", "'A' as dataset", "cast(id % 2 as int) as label", "cast(id as string) as payload")
    plan = split.intra_split(df)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    # whatever is dealt by class alone holds bucket counts: no column of a row
    seen = 0
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "_b#" not in re.search(r"hashpartitioning\((.*?), \d+\)", line).group(1):
            depth = line.index("Exchange")
            below = next(x for x in lines[k + 1:] if x.index(x.strip(" :+-*()0123456789|")) >= depth)
            assert "payload" not in below and "req_id" not in below, below
            seen += 1
    windows = [x for x in lines if "Window [row_number" in x and "_h#" in x]
    assert windows and all("_b#" in x for x in windows) and seen


def test_cross_split_holds_the_test_set(spark):
    from reqscope.operators import split

    df = spark.range(100).selectExpr("id as req_id", "if(id < 60, 'A', 'B') as dataset", "cast(id % 2 as int) as label")
    out = split.cross_split(df, [("A", "B")], seeds=[1, 2]).toPandas()
    assert out.groupby(["seed", "part"]).size().to_dict() == {(s, p): n for s in (1, 2) for p, n in (("train", 52), ("val", 8), ("test", 40))}
    assert set(out["train_dataset"]) == {"A"} and set(out["test_dataset"]) == {"B"}


def test_reason_pivot_other_models_and_duplicates(spark):
    rows = [("intra", "A", "A", m, "may", v) for m, v in (("MultinomialNB", 0.5), ("GBT", 0.7))]
    cols = "setting string, train_dataset string, test_dataset string, model string, reason string, f1 double"
    out = ranking.reason_pivot(spark.createDataFrame(rows, cols)).first().asDict()
    assert out["GBT"] == 0.7 and 0.5 in out.values()
    twice = ranking.reason_pivot(spark.createDataFrame([*rows, ("intra", "A", "A", "GBT", "may", 0.1)], cols))
    with pytest.raises(Exception, match="two values for one cell"):
        twice.collect()


def test_wilcoxon_refuses_repeated_values(spark):
    s = ("intra", "PURE", "PURE")
    rows = [(*s, m, seed, 0.1 * seed) for m in ("BERT", "RoBERTa") for seed in (1, 2, 3)]
    with pytest.raises(Exception, match="more than one value"):
        significance.wilcoxon_tests(_results(spark, [*rows, (*s, "BERT", 1, 0.9)])).collect()


def test_histogram_equals_numpy(spark):
    import numpy as np

    from reqscope.operators import profile

    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k in range(150):
        v = rng.integers(0, int(rng.integers(1, 2000)) + 1, 200)
        rows += [(f"d{k}", 0, int(x)) for x in v]
        want[f"d{k}"] = np.histogram(v, bins=30)
    df = spark.createDataFrame(rows, "dataset string, label int, word_len int")
    out = profile.length_histogram(df, cols=("word_len",)).toPandas()
    for name, g in out.groupby("dataset"):
        g = g.sort_values("bin")
        counts, edges = want[name]
        assert g["count"].tolist() == counts.tolist(), name
        assert np.allclose(g["bin_lo"], edges[:-1]) and np.allclose(g["bin_hi"], edges[1:])
