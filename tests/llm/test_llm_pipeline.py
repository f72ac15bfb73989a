"""The pipeline stage by stage against brute force, on the smallest driver tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipe
from pyspark.sql import functions as F

from reqscope.llm import lines, mixing, quality
from reqscope.session import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows, output) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, fn in pipe.STAGES:
        made = materialize(fn(spark, docs, SF), f"test_{name}")
        out[name] = (docs.toPandas(), made.toPandas())
        docs = made
    return out


def words(text):
    return (text or "").encode().lower().split()


def test_order_and_columns(stages):
    assert [n for n, _ in pipe.STAGES] == ["quality", "lines", "jaccard", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert list(stages[name][1].columns) == COLUMNS


def test_quality_keeps_what_scores_well(spark, stages):
    before, after = stages["quality"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality")
    score = quality.score(docs, weights).toPandas().set_index("doc_id")["score"]
    assert set(after["doc_id"]) == set(score[score >= 0.3].index)
    assert 0 < len(after) < len(before)


def test_lines_leave_each_line_once(stages):
    before, after = stages["lines"]
    after_text = dict(zip(after["doc_id"], after["text"]))
    norm = lambda x: tuple(lines._NORMAL[np.frombuffer(x.encode(), np.uint8)].tobytes().split())
    seen, kept = set(), []
    for r in before.sort_values("doc_id").itertuples():
        left = []
        for x in r.text.split("\n"):
            w = norm(x)
            if len(w) < 5 or w not in seen:
                left.append(x)
            seen.add(w) if len(w) >= 5 else None
        exact = "\n".join(left)
        # fuzzy groups may take more lines than equal ones do, never fewer
        got = after_text.get(r.doc_id, "")
        assert not Counter(got.split("\n")) - Counter(left) or got == ""
        kept.append(len(got) <= len(exact))
    assert all(kept)
    assert (after["n_chars"] == after["text"].map(len)).all()


def test_jaccard_leaves_one_of_each_group(stages):
    before, after = stages["jaccard"]
    sets = {}
    for r in before.itertuples():
        w = words(r.text)
        sets[r.doc_id] = frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(after["doc_id"]) == sorted({find(i) for i in ids})


def test_mixing_follows_the_rates(spark, stages):
    before, after = stages["mixing"]
    docs = spark.createDataFrame(before)
    labels = mixing.domain_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    rates = mixing.mixing_rates(docs, labels, mixing.DOMAINS, anchor="clean").toPandas()
    draws = spark.createDataFrame([(int(n),) for n in rates["nid"]], "nid long").select("nid", F.pmod(F.xxhash64("nid", F.lit(20240613)), F.lit(1 << 20)))
    draw = {r[0]: r[1] / (1 << 20) for r in draws.collect()}
    want = Counter()
    for r in rates.itertuples():
        copies = int(np.floor(r.rate)) + (draw[r.nid] < r.rate - np.floor(r.rate))
        if r.p_clean > 0.5 and np.floor(r.rate + 0.5) == 1:
            copies = 1
        want[r.nid] += int(copies)
    assert Counter(after["doc_id"]) == +want


def test_packing_holds_every_token(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in before.itertuples():
        own = after[after["doc_id"] == r.doc_id].sort_values("piece")
        assert [x for ids in own["ids"] for x in ids] == [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
    fill = after.groupby("sequence_id")["length"].sum()
    assert (fill <= 2048).all()


def test_empty_table_and_null_texts_pass(spark, tmp_path):
    rows = [(1, None, "en", "src0", 0), (2, "", "en", "src1", 0), (3, "some plain words that make a text", "en", "src1", 33), (None, "x", None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        where = str(tmp_path / name)
        spark.createDataFrame(data, kinds).write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(3, 1, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        out = pipe.run(spark, where).toPandas()
        assert len(out) == len(data)
