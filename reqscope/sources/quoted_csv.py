"""Splittable scan of quoted CSV (A1): line ends inside quotes, and still many tasks a file.

Spark's ``multiLine`` reader takes a file as one task, because a task that starts
inside a file cannot know whether it stands inside a quoted value. Here the file is
read by lines, in as many byte ranges as Spark makes of it. A line end closes a
record where the quotes before it are even in number, so a range has two possible
readings: it starts outside (state 0) or inside (state 1) a quoted value.

1. One pass numbers the lines of each range and counts, for both states, the
   records closed before each line. Lines pass through; only numbers are kept.
   The result is a written table: later steps rest on its ranges, whatever
   splits a second scan might choose.
2. A range is one row of sums; a running sum over the ranges of a file says in
   which state each one starts, and which record is open there.
3. A line that is a whole record is parsed where it lies. Only lines of records
   with line ends inside are grouped (by file, range and record number).

Values: every column a string, as Spark's CSV reader gives it. Expected form: a
value that holds a quote, a comma or a line end stands in quotes, and its quotes are
doubled. A file that ends inside quotes is an error. Records end with LF or CRLF;
inside quotes both stay as they are. Empty lines between records are passed over. A
path without data rows gives an empty table. Compressed files are one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

_LINES = "file string, block bigint, line bigint, quotes bigint, closed0 bigint, closed1 bigint, parity int, text string"


def _number_lines(batches):
    """Per range: line numbers, and for both starting states the records closed before each line."""
    here, line, closed, parity = None, 0, [0, 0], 0
    for b in batches:
        if not b.num_rows:
            continue
        file, block = b.column("file"), b.column("block").to_numpy()
        new = np.ones(b.num_rows, bool)
        new[1:] = (block[1:] != block[:-1]) | ~np.asarray(file[1:].to_numpy(False) == file[:-1].to_numpy(False), bool)
        new[0] = (file[0].as_py(), block[0]) != here
        quotes = b.column("quotes").to_numpy()
        starts = np.flatnonzero(new)
        cuts = np.unique(np.concatenate([[0], starts, [b.num_rows]]))
        out = {k: np.zeros(b.num_rows, np.int64) for k in ("line", "closed0", "closed1")}
        par = np.zeros(b.num_rows, np.int32)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if new[lo]:
                line, closed, parity = 0, [0, 0], 0
            end = (parity + np.cumsum(quotes[lo:hi])) % 2  # quotes up to the end of each line
            for s in (0, 1):
                ends = np.cumsum(end == s)
                out[f"closed{s}"][lo:hi] = closed[s] + ends - (end == s)
                closed[s] += int(ends[-1])
            out["line"][lo:hi] = line + np.arange(hi - lo)
            par[lo:hi] = end
            line, parity = line + hi - lo, int(end[-1])
        here = (file[-1].as_py(), block[-1])
        yield pa.RecordBatch.from_arrays(
            [file, b.column("block"), pa.array(out["line"]), b.column("quotes"), pa.array(out["closed0"]), pa.array(out["closed1"]),
             pa.array(par), b.column("text")],
            names=["file", "block", "line", "quotes", "closed0", "closed1", "parity", "text"],
        )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files under ``path`` as a written table, numbered within their byte range."""
    text = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))).cast("bigint").alias("quotes"),
        text.alias("text"),
    )
    return materialize(lines.mapInArrow(_number_lines, _LINES), "csv-lines")


def range_states(lines: DataFrame) -> DataFrame:
    """One row a range: ``state`` at its start, and the record (``open_block``, ``open_record``) that is open there (null: none)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.sum(F.when(F.col("parity") == 0, 1).otherwise(0)).alias("ends0"),
        F.sum(F.when(F.col("parity") == 1, 1).otherwise(0)).alias("ends1"),
    )
    blocks = blocks.withColumn("state", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    ends = F.when(F.col("state") == 0, F.col("ends0")).otherwise(F.col("ends1"))
    # the record open at the end of a range starts in it, unless the range lies inside one record as a whole
    own = F.when((F.col("state") == 0) | (ends > 0), F.struct(F.col("block").alias("open_block"), ends.alias("open_record")))
    return blocks.withColumn("own", own).select(
        "file", "block", F.col("state").cast("int").alias("state"), "quotes",
        F.when(F.col("state") == 1, F.last("own", ignorenulls=True).over(before)).alias("open"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, record, text): every record but the first (the header) of each file, as text."""
    lines = numbered_lines(spark, path)
    states = materialize(range_states(lines), "csv-ranges")
    odd = states.groupBy("file").agg((F.sum("quotes") % 2).alias("odd")).where("odd = 1").select("file").limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0]['file']} ends inside quotes")
    df = lines.join(states.drop("quotes"), ["file", "block"])
    closed = F.when(F.col("state") == 0, F.col("closed0")).otherwise(F.col("closed1"))
    starts_in = (F.col("parity") + F.col("state") + F.col("quotes")) % 2 == 1  # the line begins inside quotes
    carried = (F.col("state") == 1) & (closed == 0)
    df = df.select(
        "file",
        F.when(carried, F.col("open.open_block")).otherwise(F.col("block")).alias("rec_block"),
        F.when(carried, F.col("open.open_record")).otherwise(closed).alias("record"),
        "block", "line", "text",
        (~starts_in & (F.col("quotes") % 2 == 0)).alias("whole"),
    ).where(~((F.col("rec_block") == 0) & (F.col("record") == 0)))
    keys = ["file", "rec_block", "record"]
    single = df.where("whole").select(*keys, "text")
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "text")))
    several = df.where("not whole").groupBy(*keys).agg(F.concat_ws("\n", F.transform(parts, lambda p: p["text"])).alias("text"))
    both = single.unionByName(several).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    return both.where(F.col("text") != "").select("file", F.col("rec_block").alias("block"), "record", "text")


def read_quoted_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """The data rows under ``path`` with the columns ``header`` (each file's first record is its header and goes)."""
    schema = ", ".join(f"`c{i}` string" for i in range(len(header)))
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    row = records(spark, path).select(F.from_csv("text", schema, options).alias("r"))
    return row.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(header)])
