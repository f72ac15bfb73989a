"""Suffix-array dedup: find every byte covered by a ``length``-byte string that
also starts elsewhere, over all documents, and cut those bytes out.

A suffix matters only up to its first ``length`` bytes, and two equal strings
hold the same rarest inner gram: the ``gram``-byte window of smallest hash among
those that start in the string (leftmost of equals) - its anchor. So suffixes
that can agree stand in the same anchor group, and sorting inside the groups is
enough.

1. One scan writes a row per anchor: its gram hash, the run of string starts it
   serves, and a second hash of all bytes of that run. Anchors seen once are
   dropped by a grouped count (combined before its shuffle).
2. Runs that are equal as a whole repeat as a whole. What is left are runs that
   share an anchor but differ somewhere: the edges of repeats. One run per
   distinct kind travels as bytes to a task that suffix-sorts its string starts
   (:func:`suffix_sort`): a mergesort whose comparisons find the common
   extension of two suffixes by binary search over prefix polynomial hashes.
   Neighbours with ``length`` common bytes are repeats, once their bytes have
   been compared. Starts whose hash has no equal cannot be neighbours of that
   kind and are left out of the sort.
3. Anchor groups of more than ``hot`` kinds (a short common passage with many
   continuations) are not gathered: their string starts are counted as rows by
   two 64-bit hashes, a grouped sum like any other.
4. Spans go back to their documents and are merged.

Spans are judged on the input. Defined results: a null text is empty; a text
shorter than ``length`` keeps all bytes; equal rows repeat each other; rows that
share number and text are cut alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .common import fresh, materialize, maybe_in


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200
    gram: int = 32
    hot: int = 4096  #: kinds of runs in an anchor group above which its starts are counted as rows
    bucket: int = 20_000  #: runs per sorting task, about
    starts: int = 200_000  #: string starts that a sorting task handles at once, plus one anchor group (at most ``hot`` runs)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` items."""
    have, size = v, 1
    while 2 * size <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def _anchors(buf: np.ndarray, offsets: np.ndarray, p: RepeatParams):
    """Runs of string starts with a common anchor: document, first and last start, anchor (buffer positions), hashes."""
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    if len(buf) < p.length:
        return none
    prefix = B.prefix_hash(buf)
    at = np.arange(len(buf) - p.gram + 1)
    grams = B.span_hash(prefix, at, at + p.gram)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (_sliding_min(packed, p.length - p.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = offsets[1:] - p.length  # last start of each document
    docs = np.flatnonzero(last >= offsets[:-1])
    edge = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(edge, offsets[:-1][docs], 1)
    np.add.at(edge, last[docs] + 1, -1)
    valid = np.cumsum(edge)[:-1] > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[offsets[:-1][docs]] = True
    lo = np.flatnonzero(valid & new)
    end = np.ones(len(anchor), bool)
    end[:-1] = new[1:] | ~valid[1:]
    hi = np.flatnonzero(valid & end)
    doc = np.searchsorted(offsets, lo, side="right") - 1
    a = anchor[lo]
    whole = B.span_hash(B.prefix_hash(buf, 1), lo, hi + p.length, 1)
    kind = B.mix(whole + (a - lo).astype(np.uint64) * np.uint64(0x10001) + (hi - lo).astype(np.uint64))
    return doc, lo, hi, a, grams[a], kind


def _scan(p: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, buf, offsets in B.blocks(batch.column("text")):
                doc, lo, hi, a, gram, kind = _anchors(buf, offsets, p)
                if not len(doc):
                    continue
                at, base = pa.array(doc + row), offsets[doc]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("th").take(at), pa.array((lo - base).astype(np.int32)),
                     pa.array((hi - base).astype(np.int32)), pa.array((a - lo).astype(np.int16)), pa.array(gram.view(np.int64)),
                     pa.array(kind.view(np.int64))], names=["doc", "th", "lo", "hi", "off", "gram", "kind"])
    return run


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Common bytes of the suffixes at ``x`` and ``y``, up to ``limit``, by binary search over prefix hashes."""
    _, down = B.powers(len(prefix))
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = (prefix[x + mid] - prefix[x]) * down[x] == (prefix[y + mid] - prefix[y]) * down[y]
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)


def _less(buf, prefix, x, y, limit) -> np.ndarray:
    """Whether the suffix at ``x`` sorts before that at ``y`` within ``limit`` bytes."""
    n = common_extension(prefix, x, y, limit)
    k = np.minimum(n, limit - 1)
    return (n < limit) & (buf[x + k] < buf[y + k])


def suffix_sort(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, first ``limit`` bytes), and each one's common bytes with the one before it in its group.

    Bottom-up mergesort, all merges of a level at once: an element's place in a
    merged run is its place in its own run plus the number of smaller elements
    in the other run, which a binary search with hash comparisons finds.
    """
    prefix = B.prefix_hash(buf)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(g)))
    begin = np.repeat(first, size)  # where the element's group begins
    end = begin + np.repeat(size, size)
    place = np.arange(len(g)) - begin
    run = 1
    while len(size) and run < size.max():
        active = np.flatnonzero(end - begin > run)
        pair = place[active] // (2 * run)
        is_left = (place[active] // run) % 2 == 0
        left0 = begin[active] + pair * 2 * run
        right0 = np.minimum(left0 + run, end[active])
        right1 = np.minimum(right0 + run, end[active])
        lo = np.where(is_left, right0, left0)
        hi = np.where(is_left, right1, right0)
        other0 = lo.copy()
        me = starts[order[active]]
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            that, this = starts[order[mid]], me[live]
            # a left element counts smaller ones of the right run, a right element those of the left run not above it
            smaller = np.where(is_left[live], _less(buf, prefix, that, this, limit), ~_less(buf, prefix, this, that, limit))
            lo[live] = np.where(smaller, mid + 1, lo[live])
            hi[live] = np.where(smaller, hi[live], mid)
        own = np.where(is_left, place[active] - pair * 2 * run, place[active] - pair * 2 * run - run)
        new = left0 + own + (lo - other0)
        moved = order.copy()
        moved[new] = order[active]
        order = moved
        run *= 2
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        s = starts[order]
        common[1:] = common_extension(prefix, s[1:], s[:-1], limit)
        common[first] = 0
    return order, common


def _twice(h: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def repeated_starts(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each start equal those at another start of its group."""
    found = np.zeros(len(starts), bool)
    if not len(starts):
        return found
    h = B.span_hash(B.prefix_hash(buf), starts, starts + length)
    maybe = np.flatnonzero(_twice(h + B.mix(group)))
    if not len(maybe):
        return found
    order, common = suffix_sort(buf, starts[maybe], group[maybe], length)
    at = np.flatnonzero(common >= length)
    s = starts[maybe][order]
    step = max(1, (1 << 21) // length)
    for k in range(0, len(at), step):  # equal hashes count as equal strings only if the bytes agree
        part = at[k: k + step]
        bytes_at = np.arange(length)
        equal = (buf[s[part][:, None] + bytes_at] == buf[s[part - 1][:, None] + bytes_at]).all(axis=1)
        found[maybe[order[part[equal]]]] = True
        found[maybe[order[part[equal] - 1]]] = True
    return found


def _sort_bucket(p: RepeatParams):
    none = pd.DataFrame({"doc": np.zeros(0, np.int64), "th": np.zeros(0, np.int64), "lo": np.zeros(0, np.int32), "hi": np.zeros(0, np.int32)})

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = pdf["bytes"].tolist()
        size = np.array([len(x) for x in raw], np.int64)
        base = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(raw), np.uint8)
        n = size - p.length + 1  # starts of each run
        which = np.repeat(np.arange(len(raw)), n)
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = base[which] + rank
        gram, off = pdf["gram"].to_numpy().view(np.uint64), pdf["off"].to_numpy()
        group = B.mix(gram[which] + (off[which] - rank).astype(np.int64).view(np.uint64) * np.uint64(0x9E37))
        hit = np.flatnonzero(repeated_starts(buf, starts, group, p.length) & ~pdf["whole"].to_numpy()[which])
        if not len(hit):
            return none
        new = np.ones(len(hit), bool)
        new[1:] = (which[hit][1:] != which[hit][:-1]) | (rank[hit][1:] != rank[hit][:-1] + 1)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(hit)) - 1
        w = which[hit[at]]
        return pd.DataFrame({
            "doc": pdf["doc"].to_numpy()[w], "th": pdf["th"].to_numpy()[w],
            "lo": (pdf["lo"].to_numpy()[w] + rank[hit[at]]).astype(np.int32),
            "hi": (pdf["lo"].to_numpy()[w] + rank[hit[stop]]).astype(np.int32)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Anchor groups in portions of about ``p.starts`` starts: the arrays of a portion do not grow with the bucket."""
        pdf = pdf.sort_values("gram", kind="stable", ignore_index=True)
        gram, n = pdf["gram"].to_numpy(), pdf["bytes"].str.len().to_numpy() - p.length + 1
        first = np.r_[True, gram[1:] != gram[:-1]]
        portion = (np.cumsum(n) - n)[first][np.cumsum(first) - 1] // p.starts  # by the starts before the group
        cuts = np.flatnonzero(np.r_[True, portion[1:] != portion[:-1]])
        return pd.concat([none, *(some(pdf.iloc[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(pdf))))], ignore_index=True)

    return run


def _fetch(p: RepeatParams, hot: bool):
    """Bytes of the wanted runs of each document, or (``hot``) a row per string start with two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                mine = [w for w in wanted if w["hot"] == hot]
                if not mine:
                    continue
                text = texts[k] or b""
                doc, th = batch.column("doc")[k].as_py(), batch.column("th")[k].as_py()
                if hot:
                    buf = np.frombuffer(text, np.uint8)
                    at = np.concatenate([np.arange(w["lo"], w["hi"] + 1) for w in mine])
                    h = [B.span_hash(B.prefix_hash(buf, x), at, at + p.length, x).view(np.int64) for x in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), th)), pa.array(at.astype(np.int32)), pa.array(h[0]), pa.array(h[1])],
                        names=["doc", "th", "lo", "h1", "h2"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(mine), pa.int64()), pa.array([th] * len(mine), pa.int64()),
                         pa.array([w["lo"] for w in mine], pa.int32()), pa.array([w["off"] for w in mine], pa.int16()),
                         pa.array([w["gram"] for w in mine], pa.int64()), pa.array([w["whole"] for w in mine], pa.bool_()),
                         pa.array([text[w["lo"]: w["hi"] + p.length] for w in mine], pa.binary())],
                        names=["doc", "th", "lo", "off", "gram", "whole", "bytes"])
    return run


def repeated_spans(docs: DataFrame, p: RepeatParams = RepeatParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, th, spans array<struct<lo, hi>>)``: runs of repeated string starts (not merged) of each document that has any.

    ``doc`` is the id, or a hash of the text where that is null; ``th`` a hash of the text.
    """
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), th).alias("doc"), th.alias("th"), F.col(text).alias("text"))
    seen = materialize(slim.mapInArrow(
        _scan(p), "doc long, th long, lo int, hi int, off short, gram long, kind long"), "anchors")
    shared = materialize(seen.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared")
    near = maybe_in(seen, F.col("gram"), shared).where("maybe").drop("maybe").join(shared, "gram")
    near = materialize(near, "near")

    place = F.struct("doc", "th", "lo", "hi", "off")
    kinds = materialize(near.groupBy("gram", "kind").agg(F.count("*").alias("n"), F.min(place).alias("at")), "kinds")
    whole = near.join(kinds.where("n > 1").select("gram", "kind"), ["gram", "kind"]).select("doc", "th", "lo", "hi")

    mixed = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    edges = kinds.join(mixed, "gram").select("at.*", "gram", (F.col("n") > 1).alias("whole"), (F.col("kinds") > p.hot).alias("hot"))
    per_doc = materialize(edges.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi", "off", "gram", "whole", "hot")).alias("wanted"),
                                                         F.max("hot").alias("any_hot"), F.count("*").alias("runs")), "edges")
    texts = maybe_in(slim, F.col("doc"), per_doc.select("doc")).where("maybe").drop("maybe")
    # of equal rows one is enough: the kinds hold one place of each run
    texts = materialize(texts.join(per_doc, ["doc", "th"]).dropDuplicates(["doc", "th"]), "texts")
    runs = texts.agg(F.sum("runs")).first()[0] or 0
    contexts = texts.select("doc", "th", "text", "wanted").mapInArrow(
        _fetch(p, False), "doc long, th long, lo int, off short, gram long, whole boolean, bytes binary")
    buckets = max(1, -(-runs // p.bucket))
    by_bucket = contexts.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    partial = by_bucket.groupBy("bucket").applyInPandas(_sort_bucket(p), "doc long, th long, lo int, hi int")

    starts = materialize(texts.where("any_hot").select("doc", "th", "text", "wanted").mapInArrow(
        _fetch(p, True), "doc long, th long, lo int, h1 long, h2 long"), "starts")
    again = starts.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = starts.join(again, ["h1", "h2"]).select("doc", "th", "lo", F.col("lo").alias("hi"))

    spans = whole.union(partial).union(rows)
    return materialize(spans.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def merge_spans(spans: list, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start at ``lo .. hi``, merged where they touch or overlap."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [tuple(x) for x in out]


def _cut(at: int, spans_at: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            sizes, gone, count, kept, merged = [], [], [], [], []
            for t, spans in zip(texts, batch.column(spans_at).to_pylist()):
                t = t or b""
                ranges = merge_spans(spans or [], length)
                ends = [0, *[x for r in ranges for x in r], len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2])) if ranges else t)
                sizes.append(len(t))
                gone.append(len(t) - len(kept[-1]))
                count.append(len(ranges))
                merged.append([{"start": a, "end": b} for a, b in ranges])
            columns = [c for k, c in enumerate(batch.columns) if k != spans_at]
            names = [c for k, c in enumerate(batch.schema.names) if k != spans_at]
            extra = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()),
                     pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *(f"{k}" for k in range(5))])
    return run


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` and ``kept`` (bytes).

    Added names get underscores where ``docs`` has such columns.
    """
    found = repeated_spans(docs, p, doc_id, text)
    key, th, held = fresh(docs, "repeat_doc"), fresh(docs, "repeat_text"), fresh(docs, "repeat_spans")
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = keyed.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.col(th)))
    marked = maybe_in(keyed, F.col(key), found.select("doc"))
    maybe = marked.columns[-1]
    found = found.select(F.col("doc").alias(key), F.col("th").alias(th), F.col("spans").alias(held))
    hit = marked.where(maybe).join(found, [key, th], "left").select(*docs.columns, held)
    rest = marked.where(~F.col(maybe)).select(*docs.columns, F.lit(None).cast(found.schema[held].dataType).alias(held))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("spans", span), ("kept", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(fresh(docs, n), t) for n, t in added]])
    return hit.union(rest).mapInArrow(_cut(docs.columns.index(text), len(docs.columns), p.length), schema)
