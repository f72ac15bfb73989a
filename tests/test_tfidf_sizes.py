"""TF-IDF per training set without copies of the terms, and sizes of jobs that follow the input."""

import math

from reqscope.operators import encoder, features
from reqscope.plans import classical
from reqscope.streaming import stateful_eval


def _tables(spark):
    rows = [("A:1", 1), ("A:1", 2), ("A:all", 1), ("A:all", 2), ("A:all", 3), ("A:all", 3), ("B:all", 1), ("A:1", None)]
    terms = [(1, "x", 2), (1, "y", 1), (2, "x", 1), (2, "lost", 4), (3, "y", 3), (3, "z", 1), (None, "x", 1), (4, "x", 1)]
    vocab = [("A:1", "x", 1.5), ("A:1", "y", 2.0), ("A:all", "x", 1.25), ("A:all", "y", 1.75), ("A:all", "z", 3.0), ("C:all", "x", 9.0)]
    return rows, terms, vocab, (
        spark.createDataFrame(rows, "tset string, req_id long"), spark.createDataFrame(terms, "req_id long, term string, cnt int"),
        spark.createDataFrame(vocab, "tset string, term string, idf double"))


def test_weights_of_every_set(spark):
    rows, terms, vocab, tables = _tables(spark)
    raw = [(s, k, t, (1 + math.log(c)) * idf) for s, k in rows for key, t, c in terms if k is not None and k == key
           for s2, t2, idf in vocab if (s2, t2) == (s, t)]
    norm: dict = {}
    for s, k, _, w in raw:
        norm[s, k] = norm.get((s, k), 0.0) + w * w
    want = sorted((s, k, t, round(w / math.sqrt(norm[s, k]), 9)) for s, k, t, w in raw)  # a row given twice counts twice
    got = sorted((r["tset"], r["req_id"], r["term"], round(r["x"], 9)) for r in features.tfidf(*tables).collect())
    assert got == want and len(got) > 8


def test_terms_are_not_copied_per_set_before_they_are_joined(spark):
    *_, tables = _tables(spark)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = features.tfidf(*tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = plan.split("\n")
    copied = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange" in line for line in lines[:copied])  # nothing is shuffled after the copies


def test_a_vocabulary_needs_no_changed_texts(spark):
    req = spark.createDataFrame([(i, "A" if i % 2 else "B", f"the system may log w{i % 3}", i // 2 % 2, "may") for i in range(40)],
                                "req_id long, dataset string, requirement_text string, label int, reasons string")
    data = classical.ClassicalData(req, cross_pairs=[("A", "B"), ("B", "A")])
    assert data.vocab.count() > 0
    assert "_changed_terms" not in vars(data)
    got = data.terms_v.groupBy("variant").count().collect()
    assert {r["variant"] for r in got} == {"original", "masked_triggers", "removed_triggers"}


def test_tasks_of_word_vectors_follow_the_words():
    assert [encoder.tasks(n) for n in (None, 0, 1, encoder.TASK_WORDS, encoder.TASK_WORDS + 1, 780_000_000)] == [1, 1, 1, 1, 2, 195]


def test_state_partitions_follow_the_rows():
    assert stateful_eval.layout(10_000, 8) == {"parts": 4, "state_partitions": 8}
    for rows in (100_000_000, 1_000_000_000):
        made = stateful_eval.layout(rows, 8)
        assert rows / made["state_partitions"] <= stateful_eval.PARTITION_ROWS
        assert rows / made["parts"] <= 2.1 * stateful_eval.PARTITION_ROWS  # even if one run has all rows
