"""Stateful running evaluation: duplicates, attempts, restart, freed state, changed parts only."""

from reqscope.streaming import running_eval, stateful_eval

RUN = ("intra", "original", "PURE", "PURE", "NB", 42)
OTHER = ("intra", "original", "PURE", "PURE", "SVM", 42)
PAIRS = [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1), (0, 0), (1, 1), (0, 0), (0, 0)]


def _rows(run=RUN, pairs=PAIRS, attempt=None, step=5000):
    return [(*run, i * step, t, p, attempt) for i, (t, p) in enumerate(pairs)]


def _put(spark, src, rows):
    spark.createDataFrame(rows, running_eval.INSTANCE_SCHEMA).coalesce(1).write.mode("append").parquet(src)


def _result(spark, out):
    return {r["model"]: (r["tp"], r["fn"], r["tn"], r["fp"], r["n_test"]) for r in stateful_eval.read_results(spark, out).collect()}


def _state(spark, ckpt, name):
    return spark.read.format("statestore").option("stateVarName", name).load(ckpt).count()


def test_duplicates_attempts_restart_and_freed_state(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda **k: stateful_eval.start(spark, src, out, ckpt, state_partitions=2, parts=3, **k).awaitTermination()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _put(spark, src, _rows() + _rows()[:4] + [(*RUN, None, 1, 1, None)] * 2 + [(*OTHER, 1, 1, None, None)])
    run()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    # two rows without an id both count; a row without an answer counts in n only
    assert _result(spark, out) == {"NB": (5, 1, 4, 1, 11), "SVM": (0, 0, 0, 0, 1)}

    _put(spark, src, _rows() + [(*RUN, 7, 0, 1, None)])  # all again after a restart, and one new row
    run()
    assert _result(spark, out) == {"NB": (5, 1, 4, 2, 12), "SVM": (0, 0, 0, 0, 1)}
    second = spark.read.parquet(f"{out}/delta/epoch={max(stateful_eval._folders(spark, out, 'delta'))}").collect()
    assert len(second) <= 1 and all(r["model"] == "NB" for r in second)  # the one part that changed

    _put(spark, src, _rows(pairs=[(1, 1), (0, 0)], attempt=3) + _rows(pairs=[(1, 0)] * 9, attempt=2))
    run()
    assert _result(spark, out)["NB"] == (1, 0, 1, 0, 2)  # the higher attempt replaces, the lower one is void


def test_idle_parts_give_their_state_back(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: stateful_eval.start(spark, src, out, ckpt, state_partitions=2, parts=2, idle_ms=1, compact_every=2).awaitTermination()
    _put(spark, src, _rows())
    run()
    _put(spark, src, _rows(OTHER, [(1, 1)]))
    run()  # the timers of the first run go off
    _put(spark, src, _rows(pairs=[(1, 0)] * 9, step=7000))
    run()  # rows of the closed attempt
    _put(spark, src, _rows(OTHER, [(0, 0)], attempt=1))
    run()
    assert _result(spark, out) == {"NB": (3, 1, 4, 1, 9), "SVM": (0, 0, 1, 0, 1)}
    assert _state(spark, ckpt, "closed") >= 1
    assert _state(spark, ckpt, "counts") <= 1 and _state(spark, ckpt, "seen") <= 1  # at most the part just written
    assert stateful_eval._folders(spark, out, "base")
