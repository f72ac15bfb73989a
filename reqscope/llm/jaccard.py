"""N-gram Jaccard join by MinHash banding.

Texts are lower-cased (A-Z) and cut at white space; a text's set is its
five-word shingles (a text of 1 to 4 words has one shingle, itself). Band and
row counts are chosen so that a pair at the threshold meets in some band with
at least the target probability (:func:`choose_bands`). Rows that are equal as
word sequences are one class before any banding, and only class
representatives are banded.

Bands are shuffled on their hashes. In each bucket every member is tied to the
smallest one (a number of ties linear in the rows, whatever the bucket's size);
the connected groups of those ties hold every pair that shares a bucket. Each
group is then verified on full shingle sets: its members are dealt to tasks of
at most about ``2 * block`` sets (large groups as pairs of parts), and a task
counts common shingles by products of 0/1 matrices, so that all its pairs are
checked exactly and none is written out. What leaves a task is one row per
member: the number of verified links, and one tie to another member of its
verified component.

Result: one row per document with ``class_id`` (smallest document number of its
connected group over verified links and equal texts), ``n_links`` (other
distinct texts at or above the threshold) and ``n_equal`` (other rows with an
equal text).

Defined results: a null or blank text has no shingle, is a class of its own and
has no links; a null id takes a hash of the text as its number; rows that share
a document number share a class; an empty table gives no rows. Shingles are
64-bit hashes; two sets are told apart by two 64-bit hashes of the sequence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from .common import block_pairs, dealt_rows, each_group, fresh, materialize, maybe_in, row_key
from .components import components


@dataclass(frozen=True)
class JaccardParams:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.99  #: probability that a pair at the threshold shares a band
    max_hashes: int = 256
    block: int = 256  #: sets per part of a large group
    columns: int = 8192  #: shingles per matrix product
    bucket: int = 2000  #: sets per verification task, about


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which ``bands * rows <= max_hashes`` reaches the recall."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this threshold and recall")
    return best


def _sets(buf: np.ndarray, offsets: np.ndarray, n: int):
    """Shingles by document, word counts, and two hashes of each word sequence."""
    low = B.LOWER[buf]
    starts, ends, first = B.words(low, offsets)
    h = B.word_hashes(low, starts, ends)
    sh, sh_off = B.shingles(h, first, n)
    return sh, sh_off, np.diff(first), B.sequence_hash(h, first), B.sequence_hash(B.mix(h + B.BASES[1]), first, 1)


def min_hashes(sh: np.ndarray, sh_off: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima per non-empty document (documents without shingles get the largest value)."""
    n = len(sh_off) - 1
    out = np.full((n, count), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(sh_off[1:] > sh_off[:-1])
    if not len(full):
        return out
    at = sh_off[full]
    base = (sh >> np.uint64(32)).astype(np.uint32)
    low = sh.astype(np.uint32)
    x, y = np.empty_like(base), np.empty_like(base)
    rng = np.random.default_rng(20240229)
    for k in range(count):
        a, b, c = (int(x) for x in rng.integers(1, 1 << 32, 3))
        np.multiply(base, np.uint32(a | 1), out=x)
        np.multiply(low, np.uint32(b | 1), out=y)
        np.add(y, np.uint32(c), out=y)
        np.bitwise_xor(x, y, out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        out[full, k] = np.minimum.reduceat(x, at)
    return out


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, buf, offsets in B.blocks(batch.column("text")):
                sh, sh_off, words, h1, h2 = _sets(buf, offsets, n)
                sig = min_hashes(sh, sh_off, bands * rows).reshape(-1, bands, rows).astype(np.uint64)
                band = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(1)
                key = np.broadcast_to(B.mix(band), sig.shape[:2]).copy()
                for r in range(rows):
                    key = B.mix(key * np.uint64(31) + sig[:, :, r])
                parts.append((words, h1.view(np.int64), h2.view(np.int64), key.view(np.int64)))
            if not parts:
                continue
            words, h1, h2 = (pa.array(np.concatenate([x[k] for x in parts])) for k in range(3))
            keys = np.concatenate([x[3] for x in parts])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("nid"), words, h1, h2, lists],
                                             names=["doc_id", "nid", "n_words", "h1", "h2", "bands"])
    return run


def _links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, p: JaccardParams):
    """Which pairs (left member, right member) reach the threshold, as a matrix.

    ``left``/``right`` are member positions; equal lists mean all pairs within.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(flat) else new  # others meet no other set
    column, who = column[shared], who[shared]
    new = np.ones(len(column), bool)
    new[1:] = column[1:] != column[:-1]
    column = np.cumsum(new) - 1
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, p.columns):
        a, b = np.searchsorted(column, [lo, lo + p.columns])
        c, w = column[a:b] - lo, who[a:b]
        wide = int(c[-1]) + 1
        ml = np.zeros((len(left), wide), np.float32)
        mr = np.zeros((len(right), wide), np.float32)
        in_l, in_r = place_l[w] >= 0, place_r[w] >= 0
        ml[place_l[w[in_l]], c[in_l]] = 1
        mr[place_r[w[in_r]], c[in_r]] = 1
        common += ml @ mr.T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= p.threshold * union - 1e-6
    linked &= ids[left][:, None] != ids[right][None, :]
    return linked


def _verify(p: JaccardParams):
    def task(rows: dict) -> dict:
        ids, at = np.unique(rows["nid"], return_index=True)  # equal rows came twice; positions are in id order
        part = rows["part"][at]
        sets = [np.unique(np.frombuffer(rows["shingles"][k], np.uint64)) for k in at]
        left, right = np.flatnonzero(part == rows["i"][0]), np.flatnonzero(part == rows["j"][0])
        linked = _links(ids, sets, left, right, p)
        count = np.zeros(len(ids), np.int64)
        count[left] += linked.sum(axis=1)
        if rows["i"][0] != rows["j"][0]:
            count[right] += linked.sum(axis=0)
        # one tie per member, to the smallest member of its component in this task
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            if linked.size:
                label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], len(ids)).min(axis=1))
                label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], len(ids)).min(axis=0))
        return {"nid": ids, "links": count, "tie": ids[label]}

    return lambda pdf: each_group(pdf, ["grp", "i", "j"], task)


def _fetch_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, keep = [], []
            wanted = batch.column("h1").to_numpy()
            for row, last, buf, offsets in B.blocks(batch.column("text")):
                sh, sh_off, _, h1, _ = _sets(buf, offsets, n)
                for k in range(last - row):
                    if h1[k].view(np.int64) == wanted[row + k]:  # a row that shares the number but not the text
                        keep.append(row + k)
                        held.append(sh[sh_off[k]: sh_off[k + 1]].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("nid").take(at), batch.column("grp").take(at), batch.column("size").take(at),
                                              pa.array(held, pa.binary())], names=["nid", "grp", "size", "shingles"])
    return run


def jaccard_classes(docs: DataFrame, p: JaccardParams = JaccardParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, nid, class_id, n_links, n_equal)`` for every row of ``docs``."""
    kind = dict(docs.dtypes)[doc_id]
    bands, rows = choose_bands(p.threshold, p.recall, p.max_hashes)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("nid"))
    signed = materialize(
        slim.mapInArrow(_sign(p.n, bands, rows), f"doc_id {kind}, nid long, n_words long, h1 long, h2 long, bands array<long>"), "signed")

    worded = signed.where("n_words > 0")
    classes = worded.groupBy("h1", "h2").agg(
        F.min("nid").alias("rep"), F.count("*").alias("rows"), F.any_value("bands").alias("bands"))  # equal texts, equal bands
    classes = materialize(classes, "classes")

    member = classes.select("rep", F.explode("bands").alias("band"))
    buckets = member.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").drop("last")
    buckets = materialize(buckets, "buckets")
    shared = maybe_in(member, F.col("band"), buckets.select("band")).where("maybe").drop("maybe")
    ties = shared.join(buckets, "band").where("rep <> first").select(F.col("rep").alias("u"), F.col("first").alias("v"))
    groups = materialize(components(ties), "groups")
    sizes = materialize(groups.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    buckets = max(1, -(-dealt_rows(sizes, p.block) // p.bucket))
    wanted = groups.join(sizes, "component").join(classes.select(F.col("rep").alias("node"), "h1"), "node")
    wanted = materialize(wanted.select(F.col("node").alias("nid"), F.col("component").alias("grp"), "size", "h1"), "wanted")

    near = maybe_in(slim.select("nid", "text"), F.col("nid"), wanted.select("nid")).where("maybe").drop("maybe")
    sets = near.join(wanted, "nid").select("nid", "grp", "size", "h1", "text").mapInArrow(
        _fetch_sets(p.n), "nid long, grp long, size long, shingles binary")
    dealt = block_pairs(sets, "grp", "size", "nid", p.block, buckets)
    checked = dealt.select("bucket", "grp", "i", "j", "nid", "part", "shingles").groupBy("bucket").applyInPandas(
        _verify(p), "nid long, links long, tie long")
    checked = materialize(checked, "checked")
    links = checked.groupBy("nid").agg(F.sum("links").alias("n_links"))
    final = components(checked.select(F.col("nid").alias("u"), F.col("tie").alias("v")))

    return (
        signed.select("doc_id", "nid", "n_words", "h1", "h2")
        .join(classes.select("h1", "h2", "rep", "rows"), ["h1", "h2"], "left")
        .withColumn("rep", F.when(F.col("n_words") > 0, F.col("rep")).otherwise(F.col("nid")))
        .join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(links.select(F.col("nid").alias("rep"), "n_links"), "rep", "left")
        .select("doc_id", "nid", F.coalesce("component", "rep").alias("class_id"),
                F.when(F.col("n_words") > 0, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
                F.when(F.col("n_words") > 0, F.col("rows") - 1).otherwise(F.lit(0)).cast("long").alias("n_equal"))
    )


def keep_one(docs: DataFrame, p: JaccardParams = JaccardParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one per class: that of the smallest document number (of equal numbers, one row)."""
    key = fresh(docs, "jaccard_key")
    kept = jaccard_classes(docs, p, doc_id, text).where("nid = class_id").select(F.col("nid").alias(key)).distinct()
    return docs.withColumn(key, row_key(doc_id, text)).join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
