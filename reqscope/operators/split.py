"""Exact stratified splits.

Sizes follow the stratified shuffle-split rule: ``n_test = ceil(f * n)``;
per class the train quota is ``floor(n_c * n_train / n)`` and the units left
over go to the largest remainders (ties by class ascending); test gets the
rest of the class. Membership: inside a class, rows ordered by
``(md5(seed:salt:key), key)``; the first ``test_c`` are test.

Scale: no window ever ranks a whole class. Rows are hashed into buckets (the
leading hex digits of the md5); bucket counts (at most 16^digits per class)
give running sums, and rows are joined with them and ranked by bucket. The
running sums over a class are the only work by class, on at most 16^digits rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEEDS, TEST_SIZE, VAL_SIZE_FROM_TRAIN


def _hash(seed: str, salt: str, key: str):
    return F.md5(F.concat_ws(":", F.col(seed).cast("string"), F.lit(salt), F.col(key).cast("string")))


def class_quotas(df: DataFrame, groups, label: str = "label", test_size: float = TEST_SIZE) -> DataFrame:
    """Per (groups, class): n_c and the exact number of test rows ``test_c``."""
    counts = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n_c"))
    return quotas_from_counts(counts, groups, label, test_size)


def quotas_from_counts(counts: DataFrame, groups, label: str = "label", test_size: float = TEST_SIZE) -> DataFrame:
    """Quota arithmetic on a class-count table (groups..., label, n_c): groups x classes rows only."""
    wg = Window.partitionBy(*groups)
    n = F.sum("n_c").over(wg)
    q = counts.withColumn("n", n).withColumn("n_test", F.ceil(F.lit(test_size) * F.col("n")).cast("bigint"))
    q = q.withColumn("n_train", F.col("n") - F.col("n_test"))
    # exact integers: the product of two counts does not fit a BIGINT, and a double would make false ties
    whole = "cast(n_c as decimal(19, 0)) * cast(n_train as decimal(19, 0))"
    q = q.withColumn("fl", F.expr(f"({whole}) div cast(n as decimal(19, 0))").cast("bigint"))
    q = q.withColumn("rem", F.expr(f"({whole}) % cast(n as decimal(19, 0))"))
    q = q.withColumn("need", F.col("n_train") - F.sum("fl").over(wg))
    q = q.withColumn("rk", F.row_number().over(wg.orderBy(F.col("rem").desc(), F.col(label))))
    train_c = F.col("fl") + F.when(F.col("rk") <= F.col("need"), 1).otherwise(0)
    return q.select(*groups, label, "n_c", (F.col("n_c") - train_c).cast("bigint").alias("test_c"))


def stratified_split(
    df: DataFrame,
    groups,
    key: str = "req_id",
    label: str = "label",
    seed: str = "seed",
    test_size: float = TEST_SIZE,
    salt: str = "",
    bucket_digits: int = 5,
    out: str = "part",
    test_name: str = "test",
    train_name: str = "train",
) -> DataFrame:
    """Add ``out`` = test/train to every row of ``df`` (which carries ``seed``), exact sizes per (seed, groups, class)."""
    g = [seed] + list(groups)
    h = _hash(seed, salt, key)
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, bucket_digits), 16, 10).cast("bigint"))
    # one pass over the rows: bucket counts; class counts, quotas, running sums and the
    # boundary bucket per class are then computed on that small table only
    bc = rows.groupBy(*g, label, "_b").agg(F.count(F.lit(1)).alias("bn"))
    quotas = quotas_from_counts(bc.groupBy(*g, label).agg(F.sum("bn").alias("n_c")), g, label, test_size)
    wc = Window.partitionBy(*g, label).orderBy("_b")
    bc = bc.withColumn("cum", F.sum("bn").over(wc.rowsBetween(Window.unboundedPreceding, 0)))
    bc = bc.join(quotas, g + [label]).select(*g, label, "_b", (F.col("cum") - F.col("bn")).alias("_before"), "test_c")
    # one verdict row per bucket: the join and the rank inside a bucket share the bucket's key, so no
    # exchange or sort ever gathers a class; a bucket is test up to the class quota
    rank = F.row_number().over(Window.partitionBy(*g, label, "_b").orderBy("_h", key))
    j = rows.join(bc, g + [label, "_b"]).withColumn("_test", F.col("_before") + rank <= F.col("test_c"))
    return j.withColumn(out, F.when(F.col("_test"), F.lit(test_name)).otherwise(F.lit(train_name))).drop(
        "_h", "_b", "_before", "test_c", "_test"
    )


def with_seeds(df: DataFrame, seeds=SEEDS, seed: str = "seed") -> DataFrame:
    """Fan rows out over the seed list (bounded literal array)."""
    return df.withColumn(seed, F.explode(F.array(*[F.lit(s) for s in seeds])))


def intra_split(df: DataFrame, seeds=SEEDS, test_size: float = TEST_SIZE) -> DataFrame:
    """80/20 train/test per dataset and seed."""
    return stratified_split(with_seeds(df, seeds), ["dataset"], test_size=test_size)


def train_val_test_split(df: DataFrame, seeds=SEEDS, test_size: float = TEST_SIZE, val_size: float = VAL_SIZE_FROM_TRAIN) -> DataFrame:
    """Test first (ceil 0.2 n), then val = ceil(0.125 (n - test)) from the rest, both stratified."""
    first = stratified_split(with_seeds(df, seeds), ["dataset"], test_size=test_size)
    test = first.where(F.col("part") == "test")
    rest = stratified_split(
        first.where(F.col("part") == "train").drop("part"), ["dataset"], test_size=val_size, salt="val", test_name="val"
    )
    return test.unionByName(rest)


def cross_split(df: DataFrame, pairs, seeds=SEEDS, val_size: float = VAL_SIZE_FROM_TRAIN) -> DataFrame:
    """Per (training set, test set) pair and seed the training set split 87.5/12.5 train/val, and the whole test set.

    Adds ``train_dataset``, ``test_dataset``, ``seed`` and ``part``; ``pairs`` is a short fixed list.
    """
    def role(own: int, other: int, names) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(p[own]).alias("_own"), F.lit(p[other]).alias("_other")) for p in pairs])
        rows = with_seeds(df, seeds).withColumn("_p", F.explode(arr)).where(F.col("_p._own") == F.col("dataset"))
        return rows.withColumns({names[own]: F.col("_p._own"), names[other]: F.col("_p._other")}).drop("_p")

    names = ("train_dataset", "test_dataset")
    fit = stratified_split(role(0, 1, names), list(names), test_size=val_size, salt="val", test_name="val")
    return fit.unionByName(role(1, 0, names).withColumn("part", F.lit("test")))
