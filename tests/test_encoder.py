"""Encoder scoring: batches equal one row at a time, micro-batches keep to their bytes, a trained model separates."""

import numpy as np
import pytest

from reqscope.operators import encoder, scoring

WORDS = ["must", "may", "fast", "slow", "user", "log"]


def _arrays(d=4, window=5):
    rng = np.random.default_rng(3)
    draw = lambda *s: rng.normal(size=s)
    vectors = np.vstack([draw(len(WORDS), d), np.zeros((1, d))])
    return {"vectors": vectors, "pos": encoder.positions(window, d), "wq": draw(d, d), "wk": draw(d, d), "wv": draw(d, d),
            "head": draw(d, 2), "bias": draw(2)}


def _plain(text, a):
    """One text, one window at a time, one word at a time."""
    ids = [WORDS.index(w) if w in WORDS else len(WORDS) for w in text.lower().split()]
    window, d = a["pos"].shape
    total = np.zeros(d)
    for at in range(0, len(ids), window):
        x = np.array([a["vectors"][i] + a["pos"][j] for j, i in enumerate(ids[at:at + window])])
        for q in range(len(x)):
            s = np.array([(x[q] @ a["wq"]) @ (x[k] @ a["wk"]) for k in range(len(x))]) / np.sqrt(d)
            w = np.exp(s - s.max())
            total += x[q] + (w / w.sum()) @ (x @ a["wv"])
    return total / max(len(ids), 1) @ a["head"] + a["bias"]


def test_equals_one_row_at_a_time(spark, tmp_path):
    a, path = _arrays(), str(tmp_path / "model")
    encoder.save_weights(spark, path, WORDS, a)
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([*WORDS, "Unknown", "MUST"], size=n)) for n in (1, 2, 5, 6, 11, 400, 3, 3, 3)] + ["", "  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, requirement_text string").repartition(3)
    got = {r["id"]: r["logits"] for r in encoder.score_encoded(df, ["id"], "requirement_text", path, batch_bytes=3000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        np.testing.assert_allclose(got[i], _plain(t or "", a), atol=1e-9)
    empty = encoder.score_encoded(df.where("id < 0"), ["id"], "requirement_text", path)
    assert empty.columns == ["id", "logits"] and empty.count() == 0


def test_micro_batches_keep_to_their_bytes():
    e = encoder.Encoder(WORDS, _arrays(), batch_bytes=4000)
    lengths = np.random.default_rng(1).integers(1, 6, 200)
    parts = list(e.batches(lengths))
    assert sorted(np.concatenate(parts)) == list(range(200)) and len(parts) > 1
    for p in parts:
        n = int(lengths[p].max())
        assert len(p) == 1 or len(p) * n * (n + 16) * 8 <= 4000


def test_trained_model_and_size_bound(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(["the user"] + [("fast" if i % 2 else "slow")] * 3 + [f"w{i % 7}"]), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    path = str(tmp_path / "model")
    encoder.train(df, "t", "y", path, d=8, epochs=5)
    got = scoring.predict_argmax(encoder.score_encoded(df, ["id", "y"], "t", path))
    assert got.where("y = y_pred").count() == 120
    monkeypatch.setattr(encoder, "MAX_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        encoder.score_encoded(df, ["id"], "t", path)
