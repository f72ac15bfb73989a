"""Quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are
compared with the reference of its language by Jensen-Shannon distance (base 2,
square root of the divergence, 0 to 1). Each comparison has a minimum-length
guard: under ``min_chars`` characters or ``min_common_words`` words the
histogram is too noisy and the comparison passes. Beside this stand plain
counts: words, characters, symbols, repeated lines and repeated word triples.

References come from the corpus itself: for every language (the ``lang``
column) the class shares and the ``top_words`` most frequent words with their
shares, over all documents of at least ``min_words`` words. A language is kept
when it is among the ``max_languages`` with most words; documents of other or
null languages are compared with the pooled reference of all documents. The
reference table has at most ``max_languages + 1`` rows and is broadcast.

Defined results: a null text is empty; a text with too few words fails the base
rule; an empty table gives no rows; repeated rows are judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as B
from .common import materialize


@dataclass(frozen=True)
class RuleParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    top_words: int = 24
    min_chars: int = 200
    min_common_words: int = 80
    max_class_distance: float = 0.30
    max_word_distance: float = 0.36
    max_languages: int = 1000
    flush: int = 200_000  #: words that a task counts before it hands its partial counts on


#: Character classes: 0 lower, 1 upper, 2 non-ASCII, 3 digit, 4 symbol, 5 sentence mark, 6 other mark, 7 space,
#: 8 line end; 9: continuation byte, not a character.
N_CLASSES = 9
SYMBOLS = b"#*$%&|<>"
_CLASSES = np.full(256, 6, np.uint8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 0, 1, 3
_CLASSES[list(SYMBOLS)] = 4
_CLASSES[list(b".,;:!?'\"-()")] = 5
_CLASSES[B.SPACE] = 7
_CLASSES[10] = 8
_CLASSES[0xC0:] = 2
_CLASSES[0x80:0xC0] = 9
_IS_SYMBOL = _CLASSES == 4

POOLED = "\u0000pooled"


def _class_counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), offsets[1:] - offsets[:-1])
    flat = np.bincount(doc * 10 + _CLASSES[buf], minlength=n * 10) if len(buf) else np.zeros(n * 10, np.int64)
    return flat.reshape(n, 10)[:, :N_CLASSES]


def _partial_counts(params: RuleParams):
    """Per task: counts of words and classes by language, handed on whenever ``flush`` words are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = {}
        classes: dict[str | None, np.ndarray] = {}

        def emit():
            rows = [(lang, None, w, c) for lang, counts in held.items() for w, c in counts.items()]
            rows += [(lang, k, None, int(c)) for lang, total in classes.items() for k, c in enumerate(total) if c]
            held.clear()
            classes.clear()
            lang, cls, word, n = zip(*rows) if rows else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(cls, pa.int32()), pa.array(word, pa.binary()), pa.array(n, pa.int64())],
                names=["lang", "cls", "word", "n"])

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, last, buf, offsets in B.blocks(batch.column("text")):
                counts = _class_counts(buf, offsets)
                data = buf.tobytes()
                for k in range(last - row):
                    found = data[offsets[k]: offsets[k + 1]].lower().split()
                    if len(found) < params.min_words:
                        continue
                    lang = langs[row + k]
                    held.setdefault(lang, Counter()).update(found)
                    classes[lang] = classes.get(lang, 0) + counts[k]
                if sum(map(len, held.values())) > params.flush:
                    yield emit()
        yield emit()
    return run


def references(docs: DataFrame, params: RuleParams = RuleParams(), lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, classes array<double>, words array<binary>, shares array<double>)`` per language, and pooled."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    part = rows.mapInArrow(_partial_counts(params), "lang string, cls int, word binary, n long")
    by_lang = materialize(part.groupBy("lang", "cls", "word").agg(F.sum("n").alias("n")), "counts")  # read three times below
    both = by_lang.withColumn("lang", F.explode(F.array("lang", F.lit(POOLED)))).where("lang is not null")
    total = both.groupBy("lang", "cls", "word").agg(F.sum("n").alias("n"))
    classes = total.where("word is null").groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("classes"))  # 9 entries a language
    words = total.where("word is not null")
    sums = words.groupBy("lang").agg(F.sum("n").alias("all_words"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # Spark keeps top_words rows a task before the shuffle
    top = words.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= params.top_words)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    out = sums.join(lists, "lang").join(classes, "lang").orderBy(F.desc("all_words"), "lang").limit(params.max_languages + 1)
    share = lambda c: F.coalesce(F.element_at("classes", F.lit(c)), F.lit(0)).cast("double")
    listed = out.select("lang", F.array(*[share(c) for c in range(N_CLASSES)]).alias("classes"),
                        F.col("top.word").alias("words"),
                        F.transform("top", lambda x: x["n"] / F.col("all_words")).alias("shares"))
    return listed


class _References:
    """The collected references as arrays: class shares, word shares, and a sorted (language, word) lookup."""

    def __init__(self, rows, top: int):
        self.index = {r["lang"]: k for k, r in enumerate(rows)}
        self.classes = np.array([r["classes"] for r in rows], float).reshape(len(rows), N_CLASSES)
        self.classes /= np.maximum(self.classes.sum(axis=1, keepdims=True), 1)
        self.shares = np.zeros((len(rows), top + 1))
        keys, ranks = [], []
        for k, r in enumerate(rows):
            if r["words"]:
                buf = np.frombuffer(b"".join(map(bytes, r["words"])), np.uint8)
                ends = np.cumsum([len(w) for w in r["words"]])
                h = B.word_hashes(buf, ends - [len(w) for w in r["words"]], ends)
                keys.append(self.key(h, np.full(len(h), k)))
                ranks.append(np.arange(len(h)))
                self.shares[k, : len(h)] = r["shares"]
        self.shares[:, top] = 1 - self.shares.sum(axis=1)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], (np.concatenate(ranks) if ranks else np.zeros(0, int))[order]
        self.top = top

    @staticmethod
    def key(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return B.mix(h + B.mix(lang.astype(np.uint64) + np.uint64(1)))

    def rank(self, h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Place of each word among its language's common words; ``top`` where it is none of them."""
        if not len(self.keys):
            return np.full(len(h), self.top)
        key = self.key(h, lang)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.top)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of histograms (any scale); empty against anything: 0."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    empty = (p.sum(axis=1) == 0) | (q.sum(axis=1) == 0)
    return np.where(empty, 0.0, np.sqrt(np.clip((a + b) / 2, 0, 1)))


def _repeat_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: words inside a three-word window that occurs twice or more in that document."""
    n_docs = len(first) - 1
    if len(h) < 3:
        return np.zeros(n_docs, np.int64)
    doc = np.repeat(np.arange(n_docs), first[1:] - first[:-1])
    start = np.flatnonzero(doc[:-2] == doc[2:])
    key = B.mix(B.mix(B.mix(h[start]) * np.uint64(3) + h[start + 1]) * np.uint64(5) + h[start + 2])
    key = key + B.mix(doc[start].astype(np.uint64) + np.uint64(11))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[start[twice] + k] = True
    return B.segment_sum(inside.astype(np.int64), first)


def _judge(refs_rows, params: RuleParams):
    refs = _References(refs_rows, params.top_words)
    pooled = refs.index.get(POOLED, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            parts = []
            for row, last, buf, offsets in B.blocks(batch.column("text")):
                n = last - row
                lang = np.array([refs.index.get(x, pooled) for x in langs[row:last]], np.int64)
                starts, ends, first = B.words(buf, offsets)
                n_words = first[1:] - first[:-1]
                classes = _class_counts(buf, offsets)
                char = (~B.SPACE[buf]) & (_CLASSES[buf] != 9)
                data, dup_lines = buf.tobytes(), np.zeros(n, np.int64)
                for k in range(n):
                    lines = [x for x in data[offsets[k]: offsets[k + 1]].split(b"\n") if x.strip()]
                    dup_lines[k] = len(lines) - len(set(lines))
                repeat = _repeat_words(B.word_hashes(buf, starts, ends), first)
                doc = np.repeat(np.arange(n), n_words)
                low = B.word_hashes(B.LOWER[buf], starts, ends)
                common = np.bincount(doc * (refs.top + 1) + refs.rank(low, lang[doc]), minlength=n * (refs.top + 1))
                common = common.reshape(n, refs.top + 1).astype(float)
                if len(refs.index):
                    class_js = js_distance(classes.astype(float), refs.classes[lang])
                    word_js = js_distance(common, refs.shares[lang])
                else:
                    class_js = word_js = np.zeros(n)
                n_chars = classes.sum(axis=1)
                failed = (n_words < params.min_words) | (100 * repeat > params.max_repeat_percent * n_words)
                odd = ((n_chars >= params.min_chars) & (class_js > params.max_class_distance)) | (
                    (n_words >= params.min_common_words) & (word_js > params.max_word_distance))
                parts.append((n_words, B.segment_sum(char.astype(np.int64), offsets), B.segment_sum(_IS_SYMBOL[buf].astype(np.int64), offsets),
                              dup_lines, repeat, failed, ~failed & ~odd, class_js, word_js))
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *NAMES])
    return run


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def judge(docs: DataFrame, refs: DataFrame, params: RuleParams = RuleParams(), doc_id: str = "doc_id",
          text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdict for every row of ``docs``."""
    rows = refs.collect()  # at most max_languages + 1 rows of top_words words
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, " + ", ".join(
        f"{x} {'double' if x.endswith('distance') else 'boolean' if x in ('base_failed', 'kept') else 'long'}" for x in NAMES)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return slim.mapInArrow(_judge(rows, params), schema)
