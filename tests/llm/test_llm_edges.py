"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each text operator."""

import math

import pytest
from pyspark.sql import functions as F

from reqscope.llm import chunks, jaccard, lines, lm, packing, quality, rules, suffix

LONG = " ".join(f"long{'abcdefghij'[k % 10]}{k * 7919 % 99991}" for k in range(60_000))
PASSAGE = " ".join(f"passage{'xyz'[k % 3]} number {'abcdefghijklmnop'[k % 16]}{'qrstuv'[k % 6]}" for k in range(40))
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "de"), (5, "one", "de"), (5, "one", "de"), (None, "no number here", "en"),
    (None, None, None), (7, LONG, "en"), (8, "start " + PASSAGE + " end", "en"), (9, "other head " + PASSAGE + " other tail", "fr"), (10, "ümläut § 日本 🙂", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    for name in ("doc", "th", "nid", "class_id", "h1", "kept", "n_lines", "n_removed", "n_bytes", "spans", "shard", "place", "y", "uid", "maybe",
                 "filter_word", "line_doc", "grp", "score", "train", "words", "ids", "length", "piece", "cell"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_op1(spark, docs):
    some = labels(spark, [(4, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (9, 5, 0), (4, 1, 0)])
    w = quality.train(docs, some, "quality")
    out = quality.score(docs, w).toPandas()
    assert len(out) == len(ROWS) and out["score"].between(0, 1).all()
    kept = quality.keep_good(docs, w, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    none = quality.quality_scores(docs, labels(spark, []))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), some).count() == 0


def test_op3(spark, docs):
    out = jaccard.jaccard_classes(docs).toPandas()
    assert len(out) == len(ROWS)
    by = out.dropna(subset="doc_id").groupby("doc_id")
    assert by["class_id"].first().loc[[1, 2, 3]].tolist() == [1, 2, 3]  # blank texts stand alone
    assert by["class_id"].first().loc[[4, 5]].tolist() == [4, 4]
    assert by["n_equal"].first().loc[4] == 2
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x for x in kept.toPandas()["doc_id"].dropna().astype(int)) == [1, 2, 3, 4, 7, 8, 10]  # 9 shares nearly all of 8
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_op4(spark, docs):
    out = lm.lm_scores(docs).toPandas()
    assert len(out) == len(ROWS) and out["score"].map(math.isfinite).all() and out["base_score"].map(math.isfinite).all()
    assert out[out["doc_id"].isin([1, 2, 3])]["n_tokens"].tolist() == [1, 1, 1]
    assert out[out["doc_id"] == 7]["n_tokens"].tolist() == [60_001]
    assert out[out["doc_id"] == 5]["score"].nunique() == 1
    assert lm.lm_scores(docs.limit(0)).count() == 0
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    alone = lm.lm_scores(held).toPandas()  # no training document
    assert (alone["train_tokens"] == 0).all() and (alone["base_score"] == 0).all()


def test_op5(spark, docs):
    out = packing.pack_documents(docs).toPandas()
    assert (out["length"] == out["ids"].map(len)).all()
    assert len(out[out["doc_id"] == 5]) == 2
    assert out[out["doc_id"].isin([1, 2])]["length"].tolist() == [1, 1]
    ends = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id").agg(n=("length", "sum"))
    assert (ends["n"] <= 2048).all()
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_op7(spark, docs):
    out = suffix.remove_repeats(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.toPandas()
    assert len(rows) == len(ROWS)
    n = {r.doc_id: r.n_removed_ for r in rows.itertuples() if r.doc_id == r.doc_id}
    shared = len(PASSAGE.encode()) + 2  # the blanks around it are shared too
    assert n[8] == shared and n[9] == shared and n[4] == n[1] == n[2] == 0
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_op7_small_lengths_equal_brute_force(spark):
    """Low-entropy texts, hot anchors and tiny buckets, against all substrings."""
    import random

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 90))) for _ in range(60)]
    texts += ["a" * 70, "a" * 41, "ab" * 40, "x" * 11 + "a" * 30, "", None, texts[0], texts[1] + "c" + texts[2], "é" * 30, "zé" + "é" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [(t or "").encode() for t in texts]
    for length, hot, bucket in ((12, 4096, 20_000), (12, 2, 20_000), (9, 3, 50)):
        p = suffix.RepeatParams(length=length, gram=5, hot=hot, bucket=bucket)
        out = suffix.remove_repeats(df, p).toPandas().set_index("doc_id")
        seen = {}
        for i, t in enumerate(data):
            for s in range(len(t) - length + 1):
                seen[t[s: s + length]] = seen.get(t[s: s + length], 0) + 1
        for i, t in enumerate(data):
            mark = bytearray(len(t))
            for s in range(len(t) - length + 1):
                if seen[t[s: s + length]] > 1:
                    mark[s: s + length] = b"\1" * length
            assert bytes(out.loc[i, "kept"]) == bytes(x for x, m in zip(t, mark) if not m), (length, hot, i)


def test_op8(spark, docs):
    out = chunks.dedup_chunks(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.toPandas()
    assert len(rows) == len(ROWS)
    n = {r.doc_id: r.n_removed_ for r in rows.itertuples() if r.doc_id == r.doc_id}
    assert n[8] == 0 and n[9] > 0.6 * len(PASSAGE) and n[7] == 0
    assert chunks.dedup_chunks(docs.limit(0)).count() == 0


def test_op9(spark, docs):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_", "n_removed_"]
    assert out.count() == len(ROWS)
    assert out.where("doc_id = 1").first()["text"] is None
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    same = "five words make a line\nfew words\nFive, words make a line!\nfive words make a line"
    two = spark.createDataFrame([(2, same), (1, "x\n\nfive words make a line"), (3, "few words")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(two).collect()}
    assert got == {1: "x\n\nfive words make a line", 2: "few words", 3: "few words"}


def test_op9_large_group_dealt_in_parts(spark):
    base = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(i, " ".join([*base[:i], f"x{chr(97 + i % 26)}{chr(97 + i // 26)}q", *base[i + 1:]])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 16):
        out = lines.dedup_lines(df, lines.LineParams(block=block)).toPandas()
        assert out["n_removed"].sum() == 79 and out[out["doc_id"] == 0]["n_removed"].tolist() == [0]


def test_op10(spark, docs):
    out = rules.judge(docs, rules.references(docs)).toPandas()
    assert len(out) == len(ROWS)
    assert out[out["doc_id"] == 10]["word_chars"].tolist() == [10]
    assert rules.judge(docs.limit(0), rules.references(docs.limit(0))).count() == 0
    bare = rules.judge(docs, rules.references(docs.limit(0)))  # no reference: base rules alone
    assert bare.where("kept and base_failed").count() == 0 and bare.where("doc_id = 7 and kept").count() == 1
