import json

from reqscope.streaming import running_eval

RUN = ("intra", "original", "PURE", "PURE", "NB", 42)


def _rows():
    # (y_true, y_pred) per row of one run, spread over three files
    pairs = [(1, 1), (1, 0), (0, 0), (0, 1), (1, 1), (0, 0), (1, 1), (0, 0), (0, 0)]
    return [(*RUN, i, t, p, None) for i, (t, p) in enumerate(pairs)]


def test_running_eval_state_partitions(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    spark.createDataFrame(_rows(), running_eval.INSTANCE_SCHEMA).repartition(3).write.parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    q = running_eval.start(spark, src, out, ckpt, files_per_trigger=1, state_partitions=3)
    q.awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    r = running_eval.read_snapshot(spark, out).first()
    assert (r["tp"], r["fn"], r["tn"], r["fp"], r["n_test"]) == (3, 1, 4, 1, 9)
    assert r["precision"] == 0.75 and r["recall"] == 0.75
    assert len(list((tmp_path / "out").glob("epoch=*"))) <= 2  # older snapshots are gone
    with open(f"{ckpt}/offsets/0") as f:
        meta = json.loads(f.read().splitlines()[1])
    assert meta["conf"]["spark.sql.shuffle.partitions"] == "3"


def test_repeated_run_replaces_its_counts_across_a_restart(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    first = spark.createDataFrame(_rows(), running_eval.INSTANCE_SCHEMA)
    first.write.parquet(src)
    running_eval.start(spark, src, out, ckpt, state_partitions=2).awaitTermination()
    again = [(*RUN, i, 1, 1, 5) for i in range(5)]
    spark.createDataFrame(again, running_eval.INSTANCE_SCHEMA).write.mode("append").parquet(src)
    running_eval.start(spark, src, out, ckpt, state_partitions=2).awaitTermination()  # from the checkpoint
    r = running_eval.read_snapshot(spark, out).first()
    assert (r["tp"], r["fn"], r["tn"], r["fp"], r["n_test"]) == (5, 0, 0, 0, 5)
