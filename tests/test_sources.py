"""CSV source: all-string scan, required columns, cleaning (A1-A5)."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from reqscope.sources.labelled import MissingColumnsError, load_all_datasets, load_dataset
from reqscope.sources.results import RunStore


def test_csv_load_and_clean(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('requirement_text,label,reasons\n"The system, may be fast",1.9,"may, fast"\n,abc,\n"multi\nline",1,NA\n')
    df = load_dataset(spark, str(p), "A")
    rows = sorted(df.collect(), key=lambda r: r["requirement_text"])
    assert [r["requirement_text"] for r in rows] == ["", "The system, may be fast", "multi\nline"]
    assert [r["label"] for r in rows] == [0, 1, 1]
    assert [r["reasons"] for r in rows] == [None, "may, fast", None]


def test_missing_columns(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("text,label\nx,1\n")
    with pytest.raises(MissingColumnsError):
        load_dataset(spark, str(p), "B")


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, "/nonexistent/file.csv", "X")


def test_optional_reasons_and_union(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("requirement_text,label\nx,1\n")
    b.write_text("requirement_text,label,reasons\ny,0,etc\n")
    df = load_all_datasets(spark, {"PURE": str(a), "UserStories": str(b)})
    got = sorted((r["dataset"], r["requirement_text"], r["reasons"]) for r in df.collect())
    assert got == [("PURE", "x", None), ("UserStories", "y", "etc")]


def test_equal_rows_keep_their_own_numbers(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("requirement_text,label\n" + "same words here,1\n" * 40)
    df = load_all_datasets(spark, {"A": str(p), "B": str(p)})
    assert df.count() == 80 and df.select("req_id").distinct().count() == 80
    from reqscope.operators import features
    terms = features.doc_terms(df)
    assert terms.agg({"cnt": "max"}).first()[0] == 1


def test_boolean_and_large_labels(spark, tmp_path):
    p, q = tmp_path / "d.csv", tmp_path / "e.csv"
    p.write_text("requirement_text,label\nx,True\ny,False\nz,\n")
    q.write_text("requirement_text,label\nx,True\ny,3000000000\nz,#NA\nw,-1.#IND\n")
    got = lambda path: {r["requirement_text"]: r["label"] for r in load_dataset(spark, str(path), "D").collect()}
    assert got(p) == {"x": 1, "y": 0, "z": 0}
    assert got(q) == {"x": 0, "y": 3000000000, "z": 0, "w": 0}


def test_own_ids_are_kept(spark, tmp_path):
    path = str(tmp_path / "f.parquet")
    spark.createDataFrame([(7, "x", 1), (7, "x", 1)], "req_id long, requirement_text string, label int").write.parquet(path)
    assert [r["req_id"] for r in load_dataset(spark, path, "F", fmt="parquet").collect()] == [7, 7]


def test_sinks(spark, tmp_path):
    from reqscope.sources.labelled import save_table

    df = spark.createDataFrame([("a", 1)], "t string, n int")
    for fmt in ("csv", "json", "parquet"):
        save_table(df, str(tmp_path / fmt), fmt)
        assert spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt)).count() == 1
    save_table(df.select("t"), str(tmp_path / "text"), "text")
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "a"


def test_sets_with_and_without_numbers_are_an_error(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(7, "x", 1)], "req_id long, requirement_text string, label int").write.parquet(a)
    spark.createDataFrame([("y", 0)], "requirement_text string, label int").write.parquet(b)
    with pytest.raises(MissingColumnsError, match="req_id in B"):
        load_all_datasets(spark, {"A": a, "B": b}, fmt="parquet")


def test_run_store(spark, tmp_path):
    """Whole runs only, newest commit wins, unlike names stay apart, two writers at one number get two."""
    store = RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(FileNotFoundError):
        store.load()
    kind = "setting string, variant string, train_dataset string, test_dataset string, model string, seed int, n long"
    run = lambda model, n: spark.createDataFrame([("intra", "original", "A", "A", model, 1, x) for x in n], kind)
    assert store.save(run("a/b", [1, 2]).unionByName(run("a_b", [3])).unionByName(run(None, [4]))) == 0
    store.stage(run("a/b", [99]))  # dies before its commit
    got = lambda **k: sorted((r["model"] or "", r["n"]) for r in store.load(**k).collect())
    assert got() == [("", 4), ("a/b", 1), ("a/b", 2), ("a_b", 3)]
    first, second = store.stage(run("a/b", [5])), store.stage(run(None, [6, 7]))
    other = RunStore(spark, str(tmp_path / "runs"))
    with ThreadPoolExecutor(2) as pool:
        numbers = sorted(pool.map(lambda x: x[0].commit(x[1]), [(store, first), (other, second)]))
    assert numbers == [1, 2]
    assert got() == [("", 6), ("", 7), ("a/b", 5), ("a_b", 3)]
    assert got(models=["a_b"], settings=["intra"]) == [("a_b", 3)] and got(settings=["cross"]) == []
