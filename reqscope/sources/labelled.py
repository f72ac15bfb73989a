"""Labelled text sources: CSV/Parquet scans, column checks, type normalisation.

With ``fmt="csv"`` a file is one task, as Spark cannot split CSV with line ends
inside quotes. That is right for hand-made files and also takes stray quotes. Big
files whose quotes are properly doubled are read in many tasks with
``fmt="quoted_csv"`` (``quoted_csv.py``); Parquet is ``fmt="parquet"``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_label, csv_null, null_text
from ..session import materialize
from .quoted_csv import read_quoted_csv

TEXT_COL, LABEL_COL, REASONS_COL = "requirement_text", "label", "reasons"


class MissingColumnsError(ValueError):
    pass


def assert_required_columns(df: DataFrame, name: str, required=(TEXT_COL, LABEL_COL)) -> None:
    """A3: fail before any action when required columns are absent (names sorted)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"labelled set {name!r}: no column named {', '.join(missing)} among {', '.join(df.columns)}")


def read_labelled_csv(spark: SparkSession, path: str, name: str, multiline: bool = True, splittable: bool = False) -> DataFrame:
    """A1: CSV scan, every column as STRING (no inference); a path that Spark does not find is an error.

    ``splittable`` reads a file in many tasks (doubled quotes required, see ``quoted_csv``).
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE")
    try:
        header = reader.csv(path).columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        raise FileNotFoundError(f"labelled set {name!r}: nothing to read at {path}") from e
    if splittable:
        df = read_quoted_csv(spark, path, header)
    else:
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        df = reader.schema(schema).csv(path)
    return df.select([csv_null(F.col(c)).alias(c) for c in df.columns])


def boolean_words(df: DataFrame, col: str = LABEL_COL) -> DataFrame:
    """Turn a column whose every value reads true or false (three spellings) into 1 and 0; leave others as they are."""
    if dict(df.dtypes)[col] == "boolean":
        return df.withColumn(col, F.col(col).cast("int").cast("string"))
    if dict(df.dtypes)[col] != "string":
        return df
    word = F.col(col).isin("True", "TRUE", "true", "False", "FALSE", "false")
    seen = df.agg(F.bool_and(word).alias("all")).first()["all"]  # nulls are passed over
    return df.withColumn(col, F.when(F.lower(col) == "true", "1").when(F.lower(col) == "false", "0")) if seen else df


def normalise(df: DataFrame, name: str, required=(TEXT_COL, LABEL_COL), missing_text: str = "") -> DataFrame:
    """A3-A5: required-column check, text/label normalisation, optional reasons column."""
    assert_required_columns(df, name, required)
    df = boolean_words(df)
    if REASONS_COL not in df.columns:
        df = df.withColumn(REASONS_COL, F.lit(None).cast("string"))  # A5
    return df.withColumns(
        {
            TEXT_COL: null_text(TEXT_COL, missing_text),
            LABEL_COL: clean_label(LABEL_COL),
            REASONS_COL: F.col(REASONS_COL).cast("string"),
        }
    )


def _tagged(spark: SparkSession, path: str, name: str, fmt: str) -> DataFrame:
    csv = fmt in ("csv", "quoted_csv")
    raw = read_labelled_csv(spark, path, name, splittable=fmt == "quoted_csv") if csv else spark.read.parquet(path)
    df = normalise(raw, name)
    own = [F.col("req_id").cast("bigint").alias("req_id")] if "req_id" in df.columns else []
    return df.select(*own, F.lit(name).alias("dataset"), TEXT_COL, LABEL_COL, REASONS_COL)


def _numbered(df: DataFrame) -> DataFrame:
    """Give every physical row a number of its own and write the table, so that the numbers stay.

    Equal rows get different numbers (a hash of the content would merge them).
    """
    numbered = df.withColumn("req_id", F.monotonically_increasing_id())
    return materialize(numbered.select("req_id", *df.columns), "labelled")


def load_dataset(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> DataFrame:
    """A1+A4: one labelled set, cleaned, tagged with its dataset name and a row number (its own ``req_id`` if it has one)."""
    df = _tagged(spark, path, name, fmt)
    return df if "req_id" in df.columns else _numbered(df)


def load_all_datasets(spark: SparkSession, paths: dict[str, str], fmt: str = "csv") -> DataFrame:
    """A2: all labelled sets as one table keyed by ``dataset``; rows are numbered across the sets unless all bring a ``req_id``.

    Where only some bring one, numbers given here could meet theirs: that is an error.
    """
    sets = {n: _tagged(spark, p, n, fmt) for n, p in paths.items()}
    without = sorted(n for n, d in sets.items() if "req_id" not in d.columns)
    if without and len(without) < len(sets):
        raise MissingColumnsError(f"no column named req_id in {', '.join(without)}, but in the other labelled sets")
    table = reduce(DataFrame.unionByName, sets.values())
    return _numbered(table) if without else table


def get_xy(df: DataFrame) -> DataFrame:
    """B1: project (key, text, label)."""
    return df.select("req_id", TEXT_COL, LABEL_COL)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Sink with header for CSV; JSON/text also accepted."""
    w = df.write.mode(mode)
    if fmt == "csv":
        # every value quoted and quotes doubled, so that line ends, quotes and blanks come back as they were
        w.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "text":
        w.text(path)
    else:
        w.parquet(path)
