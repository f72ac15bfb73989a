"""Scalar text expressions (all JVM-side ``Column`` builders, no UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MASK_TOKEN, PROMPT_PREFIX, TOKEN_PATTERN, TRIGGER_TERMS

# Every code point Python's str.split()/str.strip() treat as whitespace.
WS_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
WS_RUN = WS_CLASS + "+"

# Numbers the label coercion accepts (optional blanks, sign, decimal, exponent).
NUMERIC_RE = r"^[ \t\n\r\f\x0b]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\x0b]*$"

# FIXED VALUES: words that the reference's CSV reader takes as missing.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Strip leading/trailing whitespace (Python ``str.strip`` semantics)."""
    return F.regexp_replace(_c(col), f"^{WS_RUN}|{WS_RUN}$", "")


def char_len(col) -> Column:
    """H1: number of code points."""
    return F.length(_c(col))


def words(col) -> Column:
    """Whitespace-split words, empties dropped (``str.split()``)."""
    return F.filter(F.split(_c(col), WS_RUN), lambda x: x != "")


def word_len(col) -> Column:
    """H2: number of whitespace-separated words."""
    return F.size(words(col))


def null_text(col, missing: str = "") -> Column:
    """Text normalisation: missing -> ``missing`` (default empty, ``"nan"`` optional)."""
    return F.coalesce(_c(col).cast("string"), F.lit(missing))


def csv_null(col) -> Column:
    """Map the words a CSV reader treats as missing to NULL."""
    c = _c(col)
    return F.when(c.isin(*NULL_WORDS), F.lit(None).cast("string")).otherwise(c)


def clean_label(col) -> Column:
    """Coerce to a number; anything non-numeric -> 0; fractions truncate toward zero.

    The result is a BIGINT; a number outside its range counts as non-numeric.
    The words ``true``/``false`` are no numbers here: a column that holds
    nothing else is a boolean column and must be cast before (see
    ``sources.labelled.boolean_words``).
    """
    s = _c(col).cast("string")
    num = strip_ws(s).try_cast("double")
    return (
        F.when(s.rlike(NUMERIC_RE) & (F.abs(num) < 2.0 ** 63), F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)).cast("bigint"))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def safe_float(col) -> Column:
    """Numeric text -> double, anything else -> NULL (never NaN)."""
    s = _c(col).cast("string")
    return F.when(s.rlike(NUMERIC_RE), strip_ws(s).try_cast("double"))


def parse_reasons(col) -> Column:
    """H3: comma list -> array of stripped, non-empty items; NULL -> []."""
    parts = F.split(F.coalesce(_c(col).cast("string"), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: strip_ws(x)), lambda x: x != "")


def term_forms(term: str) -> list[str]:
    """The three case forms the lexicon replaces, in replacement order."""
    return [term, term.capitalize(), term.upper()]


def _fold_replace(col, replacement: str) -> Column:
    return reduce(
        lambda acc, form: F.replace(acc, F.lit(form), F.lit(replacement)),
        [form for term in TRIGGER_TERMS for form in term_forms(term)],
        _c(col),
    )


def mask_triggers(col, token: str = MASK_TOKEN) -> Column:
    """H4: sequential literal replacement of every term form, in list order."""
    return _fold_replace(col, token)


def remove_triggers(col) -> Column:
    """H5: replace every term form by a blank, then collapse whitespace."""
    return F.array_join(words(_fold_replace(col, " ")), " ")


def trigger_hits(col) -> Column:
    """Array of matched terms (any case form, substring match), in list order."""
    c = _c(col)
    hits = [
        F.when(reduce(lambda a, b: a | b, [F.contains(c, F.lit(f)) for f in term_forms(t)]), F.lit(t))
        for t in TRIGGER_TERMS
    ]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def label_to_text(col) -> Column:
    """H6: 1 -> 'yes', else 'no'."""
    return F.when(_c(col) == 1, F.lit("yes")).otherwise(F.lit("no"))


def text_to_label(col) -> Column:
    """H6: verbaliser back to a label (prefix yes/no first, then any 'yes')."""
    t = F.lower(strip_ws(F.coalesce(_c(col).cast("string"), F.lit(""))))
    return (
        F.when(t.startswith("yes"), F.lit(1))
        .when(t.startswith("no"), F.lit(0))
        .when(F.contains(t, F.lit("yes")), F.lit(1))
        .otherwise(F.lit(0))
    )


def build_prompt(col) -> Column:
    """H7: text-to-text prompt."""
    return F.concat(F.lit(PROMPT_PREFIX), _c(col))


def argmax(col) -> Column:
    """0-based index of the largest element (first on ties)."""
    return F.array_position(_c(col), F.array_max(_c(col))).cast("int") - 1


def pvalue_text(col) -> Column:
    """H8: NULL -> '--', below 0.001 -> '<0.001', else 3 decimals (half-even)."""
    p = _c(col)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("--"))
        .when(p < 0.001, F.lit("<0.001"))
        .otherwise(F.format_string("%.3f", F.bround(p, 3)))
    )


def yes_no(col, alpha: float = 0.05) -> Column:
    """H9: 'Yes' iff p < alpha; NULL -> 'No'."""
    return F.when(_c(col) < alpha, F.lit("Yes")).otherwise(F.lit("No"))


def fixed3(col) -> Column:
    """Three-decimal text of a mean; NULL -> 'nan' (as a formatted float would read)."""
    return F.coalesce(F.format_string("%.3f", F.bround(_c(col), 3)), F.lit("nan"))


def safe_name(col) -> Column:
    """File-safe model name."""
    return F.translate(_c(col), "/", "_")


def word_tokens(col) -> Column:
    """Lower-case tokens of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def uni_bi_grams(tokens) -> Column:
    """Unigrams followed by space-joined bigrams of adjacent tokens.

    ``tokens`` must be an already computed array column (see ``word_tokens``):
    the bigrams reference it twice, so it must not be a regex expression that
    would be re-evaluated per element.
    """
    toks = _c(tokens)
    n = F.size(toks)
    pairs = F.arrays_zip(F.slice(toks, 1, n - 1).alias("l"), F.slice(toks, 2, n - 1).alias("r"))
    bigrams = F.transform(pairs, lambda p: F.concat(p["l"], F.lit(" "), p["r"]))
    return F.when(n >= 2, F.concat(toks, bigrams)).otherwise(toks)


def percent_text(col, digits: int = 2) -> Column:
    """A share as percent text at the output edge (0.1234 -> '12.34%'), half-even."""
    return F.format_string(f"%.{digits}f%%", F.bround(_c(col) * 100.0, digits))


def round2(col) -> Column:
    """Runtime seconds to 2 places, half-even.

    Python rounds the exact binary value; this rounds the shortest decimal
    text, so the two differ only when that text has exactly three decimals
    ending in 5 (2.675 -> 2.68 here, 2.67 in Python) - never for measured times.
    """
    return F.bround(_c(col), 2)
