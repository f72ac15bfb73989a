"""Helpers shared by the operators: tables, fresh column names, bounded filters, block pairs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

__all__ = ["block_pairs", "dealt_rows", "drop_scratch", "each_group", "fresh", "materialize", "maybe_in", "read", "row_key"]

#: Words of 64 bits in the filter of :func:`maybe_in`: 2 MB however large the data.
FILTER_WORDS = 1 << 18


BATCH_ROWS = 2000

#: Paths of the tables that :func:`materialize` wrote and :func:`drop_scratch` may delete.
_SCRATCH: list[str] = []


def materialize(df: DataFrame, name: str, scratch: bool = True, rows: int = BATCH_ROWS) -> DataFrame:
    """Cut lineage by a written table in the session's shared checkpoint folder; Python gets up to ``rows`` rows at once, at most ``BATCH_ROWS``."""
    spark = df.sparkSession
    path, batch = session.shared_path(spark, f"{name}-{uuid.uuid4().hex}"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    # rows that a scan hands to Python at once: fewer than the default, since texts can be long
    rows = min(rows, BATCH_ROWS)
    spark.conf.set(batch, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(batch, before)
    if scratch:
        _SCRATCH.append(path)
    return spark.read.parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far.

    For callers that have written every result they still need, as a pipeline
    has between its stages: results that were not written cannot be read after.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Node number of a document: its id, or a hash of its text where the id is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, words: int = FILTER_WORDS) -> Column:
    """Join ``df`` with a fixed-size bitmap of ``keys`` (one long column): adds a boolean column ``maybe``.

    A one-hash Bloom filter of ``64 * words`` bits made by a grouped ``bit_or``.
    Its size does not depend on the data, so it may be broadcast. A false hit
    costs time only: callers join the rows that pass on the exact key. When the
    keys fill the bitmap, every row passes and nothing else changes.
    """
    (name,) = keys.columns
    word = fresh(df, "filter_word")
    bits = fresh(df, "filter_bits")
    hashed = F.pmod(F.xxhash64(F.col(name)), F.lit(64 * words))
    bitmap = (
        keys.select(hashed.alias("h"))
        .groupBy(F.floor(F.col("h") / 64).cast("int").alias(word))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias(bits))
    )
    mine = F.pmod(F.xxhash64(key), F.lit(64 * words))
    h = fresh(df, "filter_hash")
    out = df.withColumn(h, mine).withColumn(word, F.floor(F.col(h) / 64).cast("int"))
    out = out.join(F.broadcast(bitmap), word, "left")
    hit = F.expr(f"(shiftright(coalesce(`{bits}`, 0L), cast(`{h}` % 64 as int)) & 1L) = 1L")
    return out.withColumn(fresh(df, "maybe"), hit).drop(word, bits, h)


def dealt_rows(sizes: DataFrame, block: int) -> int:
    """Rows that :func:`block_pairs` makes of groups with these ``size`` values."""
    return int(sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / F.lit(float(block))))).first()[0] or 0)


def each_group(pdf: pd.DataFrame, keys: list[str], fn: Callable[[dict], dict]) -> pd.DataFrame:
    """Concatenated results of ``fn`` over the groups of a bucket of many small groups."""
    pdf = pdf.sort_values(keys, kind="stable")
    columns = {c: pdf[c].to_numpy() for c in pdf.columns}
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= columns[k][1:] != columns[k][:-1]
    at = np.flatnonzero(new)
    parts = [fn({c: v[a:b] for c, v in columns.items()}) for a, b in zip(at, np.append(at[1:], len(pdf)))]
    return pd.DataFrame({c: np.concatenate([x[c] for x in parts]) for c in parts[0]})


def block_pairs(members: DataFrame, group: str, size: str, node: str, block: int, buckets: int) -> DataFrame:
    """Deal each group's members to tasks that each hold at most about ``2 * block`` members.

    A group of up to ``block`` members is one task. A larger one is cut into
    ``c = ceil(size / block)`` parts by hash, and each pair of parts (i <= j) is
    a task of its own; a member goes to the ``c`` tasks of its part. Every pair
    of members meets in at least one task, and no task grows with the group.
    Adds ``part``, ``parts``, ``i`` and ``j``, and the ``bucket`` (of ``buckets``)
    that gathers many small tasks into one.
    """
    parts = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    out = members.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.col(node)), F.col("parts").cast("long")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    return out.withColumn("bucket", F.pmod(F.xxhash64(group, "i", "j"), F.lit(buckets)))
