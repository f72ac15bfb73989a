"""Labelled-text tables derived from the driver tables (documents, labels).

The evaluated workload reads two labelled requirement sets and the result
tables its experiments write. Those rows are not available, so they are
derived deterministically from ``documents`` and ``labels`` (every step is a
Spark job whose work grows with those tables):

* ``requirements_plain`` - documents joined with labels; the source number
  picks the dataset (even -> PURE, odd -> UserStories); label = 1 - quality.
* ``requirements`` - the same with trigger terms appended, so the lexicon
  operators have something to find; ``reasons`` lists the matched terms.
* ``instances`` - per-row predictions of pseudo-models: a model flips the
  true label when an md5 of (model, seed, row, setting, variant) falls under
  the model's cut, giving realistic, non-degenerate metric spreads.

The same recipes are written in SQL for the DuckDB oracle (plans/sqlparts.py);
``CASE`` texts below are shared by both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEEDS, TRIGGER_TERMS
from ..operators.lexicon import with_reasons
from ..session import spread

DATASET_EVEN, DATASET_ODD = "PURE", "UserStories"

# FIXED VALUES (fixture recipe): pseudo-model error cuts, two hex digits; a row
# is mispredicted when the first two hex digits of its md5 sort below the cut.
CLASSICAL_CUTS = {
    "MultinomialNB": "1a",
    "LinearSVM": "26",
    "RandomForest": "33",
    "LightGBM": "4d",
    "XGBoost": "80",
}
NEURAL_CUTS = {
    "distilbert-base-uncased": "2a",
    "bert-base-uncased": "20",
    "roberta-base": "18",
    "albert-base-v2": "40",
    "t5-small": "5c",
    "google/flan-t5-small": "f0",
}
VARIANTS = ["original", "masked_triggers", "removed_triggers"]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def term_case(index_sql: str, form: str = "plain") -> str:
    """CASE text mapping an index 0..14 to a term form (index 14 = empty)."""
    def f(t: str) -> str:
        return {"plain": t, "cap": t.capitalize(), "upper": t.upper()}[form]
    whens = " ".join(f"WHEN {i} THEN {_sql_str(f(t))}" for i, t in enumerate(TRIGGER_TERMS))
    return f"(CASE {index_sql} {whens} ELSE '' END)"


def injected_text_sql(id_sql: str = "doc_id", text_sql: str = "text") -> str:
    """SQL text of the term injection (identical in Spark SQL and DuckDB)."""
    n = len(TRIGGER_TERMS) + 1
    first_idx = f"({id_sql} % {n})"
    first = (
        f"(CASE {id_sql} % 3 WHEN 0 THEN {term_case(first_idx, 'plain')} "
        f"WHEN 1 THEN {term_case(first_idx, 'cap')} ELSE {term_case(first_idx, 'upper')} END)"
    )
    second = term_case(f"(({id_sql} * 7 + 3) % {n})", "plain")
    return (
        f"(CASE WHEN {id_sql} % 5 = 0 THEN {text_sql} "
        f"ELSE concat({text_sql}, ' System ', {first}, ' be ', {second}, '.') END)"
    )


def dataset_sql(source_sql: str = "source") -> str:
    return (
        f"(CASE WHEN cast(substr({source_sql}, 4) AS INT) % 2 = 0 "
        f"THEN '{DATASET_EVEN}' ELSE '{DATASET_ODD}' END)"
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The documents scan (pruned to ``cols``), spread over the cores where the session asks for it."""
    return spread(read_table(spark, sf_dir, "documents").select(*cols), "doc_id" if "doc_id" in cols else cols[0])


#: Label of the plain fixtures, and one that follows the injected terms (the lower half of the lexicon is positive).
QUALITY_LABEL_SQL = "1 - quality"
TEXT_LABEL_SQL = f"CASE WHEN doc_id % 5 = 0 THEN 0 WHEN (doc_id * 7 + 3) % {len(TRIGGER_TERMS) + 1} < {(len(TRIGGER_TERMS) + 1) // 2} THEN 1 ELSE 0 END"


def requirements_plain(spark: SparkSession, sf_dir: str, label_sql: str = QUALITY_LABEL_SQL) -> DataFrame:
    """labelled requirement rows (req_id, dataset, requirement_text, label, reasons)."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("req_id"),
        F.expr(dataset_sql()).alias("dataset"),
        F.col("text").alias("requirement_text"),
        F.expr(label_sql).cast("int").alias("label"),
        F.lit(None).cast("string").alias("reasons"),
    )


def requirements(spark: SparkSession, sf_dir: str, label_sql: str = QUALITY_LABEL_SQL) -> DataFrame:
    """labelled rows with injected trigger terms and a ``reasons`` list."""
    base = requirements_plain(spark, sf_dir, label_sql).withColumn(
        "requirement_text", F.expr(injected_text_sql("req_id", "requirement_text"))
    )
    return with_reasons(base)


# Values as a hand-made CSV has them (the same text in both engines): null words, quotes, line ends, blanks around, repeated
# rows; fractions, words, blanks and large numbers as labels.
MESSY_TEXT_SQL = """CASE doc_id % 9 WHEN 0 THEN 'NA' WHEN 1 THEN concat('say "', text, '", "twice"') WHEN 2 THEN NULL
  WHEN 3 THEN concat('  ', text, ' ') WHEN 4 THEN '#N/A' WHEN 5 THEN 'one line, with a comma' ELSE text END"""
MESSY_LABEL_SQL = """CASE doc_id % 8 WHEN 0 THEN '1.9' WHEN 1 THEN ' 1 ' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN '3000000000'
  WHEN 5 THEN '-1.5' WHEN 6 THEN '1e0' ELSE cast(quality AS {text}) END"""
MESSY_REASONS_SQL = "CASE doc_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'may, fast' WHEN 2 THEN ' , may,,' ELSE NULL END"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, requirement_text, label, reasons) as raw strings, every tenth row twice."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    rows = docs.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        F.expr(dataset_sql()).alias("dataset"), F.expr(MESSY_TEXT_SQL).alias("requirement_text"),
        F.expr(MESSY_LABEL_SQL.format(text="STRING")).alias("label"), F.expr(MESSY_REASONS_SQL).alias("reasons"))


def model_cuts(models: dict[str, str] | None = None) -> dict[str, str]:
    return dict(models) if models else {**CLASSICAL_CUTS, **NEURAL_CUTS}


def grid_column(cuts: dict[str, str]):
    """C4: experiment grid model x seed x variant as a literal array (classical models
    also get the two text variants). Exploding it fans each row out without a join."""
    cells = []
    for m, cut in cuts.items():
        vs = VARIANTS if m in CLASSICAL_CUTS else VARIANTS[:1]
        cells += [
            F.struct(F.lit(m).alias("model"), F.lit(cut).alias("cut"), F.lit(s).alias("seed"), F.lit(v).alias("variant"))
            for s in SEEDS for v in vs
        ]
    return F.array(*cells)


def instances(spark: SparkSession, sf_dir: str, models: dict[str, str] | None = None) -> DataFrame:
    """Prediction rows for intra and cross settings of every (model, seed, variant)."""
    req = requirements(spark, sf_dir)
    other = F.when(F.col("dataset") == DATASET_EVEN, F.lit(DATASET_ODD)).otherwise(F.lit(DATASET_EVEN))
    settings = F.array(
        F.struct(F.lit("intra").alias("setting"), F.col("dataset").alias("train_dataset")),
        F.struct(F.lit("cross").alias("setting"), other.alias("train_dataset")),
    )
    rows = req.select(
        "req_id", F.explode(settings).alias("s"), F.col("dataset").alias("test_dataset"),
        "requirement_text", "label", "reasons",
    ).select("*", "s.*").drop("s")
    j = rows.withColumn("g", F.explode(grid_column(model_cuts(models)))).select("*", "g.*").drop("g")
    h = F.substring(
        F.md5(F.concat_ws(":", "model", F.col("seed").cast("string"), F.col("req_id").cast("string"), "setting", "variant")),
        1, 2,
    )
    return j.select(
        "setting", "variant", "train_dataset", "test_dataset", "model",
        F.col("seed").cast("int").alias("seed"), "req_id",
        F.col("requirement_text").alias("text"),
        F.col("label").cast("int").alias("y_true"),
        F.when(h < F.col("cut"), 1 - F.col("label")).otherwise(F.col("label")).cast("int").alias("y_pred"),
        "reasons",
    )
