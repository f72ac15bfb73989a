"""Literal cases of the scalar text expressions (FIXTURES.md F5)."""

import pytest
from pyspark.sql import functions as F

from reqscope.functions import text as T


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,expected", [
    ("abc", 0), (None, 0), ("1d", 0), ("1_0", 0), ("0x1", 0),
    ("1.9", 1), (" 1 ", 1), ("+1", 1), ("1e0", 1), ("-1.9", -1), ("0", 0), ("1", 1),
])
def test_clean_label(spark, raw, expected):
    assert one(spark, T.clean_label, raw) == expected


@pytest.mark.parametrize("raw,expected", [("", 0), ("  a b ", 2), ("a b c", 3), ("a\x1cb", 2), ("a　b c", 3)])
def test_word_len(spark, raw, expected):
    assert one(spark, T.word_len, raw) == expected


def test_parse_reasons(spark):
    assert one(spark, T.parse_reasons, "a,, b ,") == ["a", "b"]
    assert one(spark, T.parse_reasons, None) == []
    assert one(spark, T.parse_reasons, " \t ") == []


@pytest.mark.parametrize("raw,expected", [
    ("maybe", "[TRIGGER]be"), ("MAY", "[TRIGGER]"), ("User-Friendly", "User-Friendly"),
    ("And/Or", "And/Or"), ("etcould", "et[TRIGGER]"), ("User-friendly", "[TRIGGER]"), ("AND/OR", "[TRIGGER]"),
])
def test_mask(spark, raw, expected):
    assert one(spark, T.mask_triggers, raw) == expected


def test_remove(spark):
    assert one(spark, T.remove_triggers, "ifmayneeded") == ""
    assert one(spark, T.remove_triggers, "  the system should  be fast ") == "the system be"


def test_trigger_hits(spark):
    assert one(spark, T.trigger_hits, "It May be FAST, etc.") == ["may", "fast", "etc"]
    assert one(spark, T.trigger_hits, "nothing here") == []


@pytest.mark.parametrize("raw,expected", [("Yes.", 1), ("well yes", 1), ("not yes", 0), ("no", 0), ("", 0), (None, 0), ("  YES ", 1)])
def test_verbaliser(spark, raw, expected):
    assert one(spark, T.text_to_label, raw) == expected


def test_label_to_text_and_prompt(spark):
    assert one(spark, T.label_to_text, 1, "int") == "yes"
    assert one(spark, T.label_to_text, 0, "int") == "no"
    assert one(spark, T.build_prompt, "x") == "is this requirement ambiguous? requirement: x"


@pytest.mark.parametrize("p,expected", [(None, "--"), (0.0005, "<0.001"), (0.0625, "0.062"), (0.5, "0.500"), (1.0, "1.000")])
def test_pvalue_text(spark, p, expected):
    assert one(spark, T.pvalue_text, p, "double") == expected


def test_yes_no_and_argmax(spark):
    assert one(spark, T.yes_no, 0.01, "double") == "Yes"
    assert one(spark, T.yes_no, None, "double") == "No"
    assert one(spark, T.argmax, [0.1, 0.7, 0.7], "array<double>") == 1


def test_tokens_and_grams(spark):
    df = spark.createDataFrame([("The Système, a b_c x!",)], "v string").select(T.word_tokens("v").alias("tk"))
    row = df.select("tk", T.uni_bi_grams("tk").alias("g")).first()
    assert row["tk"] == ["the", "système", "b_c"]
    assert row["g"] == ["the", "système", "b_c", "the système", "système b_c"]


def test_percent_and_round2(spark):
    assert one(spark, T.percent_text, 0.1234, "double") == "12.34%"
    assert one(spark, T.percent_text, 0.0, "double") == "0.00%"
    assert one(spark, T.round2, 1.005, "double") == 1.0
    assert one(spark, T.round2, 12.345678, "double") == 12.35
    assert one(spark, T.round2, 0.125, "double") == 0.12
