"""Degenerate metric rows and closed-form test statistics (FIXTURES.md F5, SURVEY App. B)."""

import math

import pytest
from pyspark.sql import functions as F

from reqscope.constants import METRICS
from reqscope.functions.metrics import metric_columns
from reqscope.functions.stats import normal_two_sided_p, signed_rank_p, t_two_sided_p


def metrics_of(spark, tn, fp, fn, tp):
    df = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    return df.select(*metric_columns()).first().asDict()


def test_tp_only(spark):
    m = metrics_of(spark, 0, 0, 0, 5)
    assert [m[k] for k in METRICS[:6]] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]
    assert m["cohen_kappa"] is None


def test_fn_only(spark):
    m = metrics_of(spark, 0, 0, 5, 0)
    assert [m[k] for k in METRICS] == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_tn_only(spark):
    m = metrics_of(spark, 5, 0, 0, 0)
    assert [m[k] for k in METRICS[:6]] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert m["cohen_kappa"] is None


def test_mixed_against_formulas(spark):
    tn, fp, fn, tp = 50, 10, 5, 35
    m = metrics_of(spark, tn, fp, fn, tp)
    n = tn + fp + fn + tp
    assert m["accuracy"] == pytest.approx((tp + tn) / n)
    assert m["balanced_accuracy"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    assert m["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert m["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    po, pe = (tp + tn) / n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / n**2
    assert m["cohen_kappa"] == pytest.approx((po - pe) / (1 - pe))


@pytest.mark.parametrize("t,df,p", [
    (2.776445, 4, 0.05), (4.604095, 4, 0.01), (8.610302, 4, 0.001),
    (2.0, 1, 0.295167), (2.0, 2, 0.183503), (2.0, 3, 0.139326), (2.0, 4, 0.116117), (2.0, 9, 0.076553), (2.0, 10, 0.073388),
    (0.0, 4, 1.0),
])
def test_student_t(spark, t, df, p):
    r = spark.createDataFrame([(t, df)], "t double, v int").select(t_two_sided_p("t", "v").alias("p")).first()["p"]
    assert r == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize("ranks", [[1, 2, 3, 4, 5], [1, 2, 3, 4], [1.5, 1.5, 3, 4.5, 4.5], [3, 3, 3, 3, 3, 6, 7, 8], [1]])
def test_signed_rank_p_bruteforce(spark, ranks):
    """Every reachable statistic against all sign assignments, with and without ties."""
    from itertools import product
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in product([0, 1], repeat=len(ranks))]
    doubled = [int(2 * r) for r in ranks]
    rows = [(doubled, int(2 * s)) for s in sorted(set(sums))]
    got = spark.createDataFrame(rows, "r array<int>, s int").select("s", signed_rank_p("r", "s").alias("p")).collect()
    for r in got:
        want = min(1.0, 2 * sum(x <= r["s"] / 2 for x in sums) / 2 ** len(ranks))
        assert r["p"] == pytest.approx(want)


def test_signed_rank_p_many_ranks(spark):
    """Sixty pairs: more sign assignments than a long holds."""
    m = 60
    counts = [1]
    for r in range(1, m + 1):
        counts = [(counts[i] if i < len(counts) else 0) + (counts[i - r] if 0 <= i - r < len(counts) else 0) for i in range(len(counts) + r)]
    stat = 700
    want = 2 * sum(counts[: stat + 1]) / 2 ** m
    got = spark.createDataFrame([([2 * r for r in range(1, m + 1)], 2 * stat)], "r array<int>, s int").select(signed_rank_p("r", "s").alias("p")).first()["p"]
    assert got == pytest.approx(want, rel=1e-9)


def test_normal_tail_matches_math_erfc(spark):
    zs = [0.0, 1e-6, 0.3, -1.0, 1.959963984540054, 3.0, -4.5, 7.0, 7.0710678118654755, 7.2, 9.5, 12.0, 20.0, 40.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double")
    got = {r["z"]: r["p"] for r in df.select("z", normal_two_sided_p("z").alias("p")).collect()}
    assert got[None] is None
    for z in zs:
        want = math.erfc(abs(z) / math.sqrt(2.0))
        assert got[z] == pytest.approx(want, rel=1e-12, abs=1e-15), z
