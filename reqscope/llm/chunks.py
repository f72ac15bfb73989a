"""Substring dedup by content-defined chunking.

A gear rolling hash runs over each text: ``h = (h << 2) + gear[byte]`` in 32
bits, so that it depends on the last 16 bytes only. A chunk ends where the top
``mask_bits`` bits are zero, not before ``min_bytes`` and at ``max_bytes`` at
the latest; cuts therefore move with the content, and an insertion changes the
chunks around it and no others. A last chunk shorter than ``min_bytes`` joins
the one before it; a text shorter than that is one chunk.

Chunks are deduplicated by a 128-bit digest over all documents: the first
occurrence stays (smallest document number, then place), all later ones go. A
64-bit part of the digest first sieves out the chunks that occur once, so that
only repeated ones travel with their places. Runs of repeated chunks shorter than
``min_run`` bytes stay, since a short common line is no passage, unless the run
is the whole document: a copied document goes however short it is.

Defined results: a null or empty text has no chunks; of documents with equal
texts the smallest number keeps its chunks; rows that share both number and text
(a null number counts as the text's hash) are one occurrence and are cut alike;
empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as B
from .common import fresh, materialize, maybe_in


@dataclass(frozen=True)
class ChunkParams:
    mask_bits: int = 4  #: a cut every 16 bytes on average after the minimum
    min_bytes: int = 16  #: not under the hash's window, so that no cut depends on the text before
    max_bytes: int = 1024
    min_run: int = 96


#: 256 gear numbers from a fixed seed.
GEAR = np.random.default_rng(20231101).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hash(buf: np.ndarray) -> np.ndarray:
    """Rolling hash after each byte: the sum over the last 16 bytes of ``gear[byte] << 2 * age``, by doubling."""
    h, width = GEAR[buf], 1
    while width < 16:
        out = h.copy()
        out[width:] += h[:-width] << np.uint32(2 * width)
        h, width = out, width * 2
    return h


def cuts(buf: np.ndarray, offsets: np.ndarray, p: ChunkParams) -> Iterator[list[int]]:
    """Ends of each document's chunks, relative to the document."""
    mark = np.flatnonzero(gear_hash(buf) >> np.uint32(32 - p.mask_bits) == 0) + 1  # a chunk may end before these positions
    first = np.searchsorted(mark, offsets)
    for d in range(len(offsets) - 1):
        base, n = int(offsets[d]), int(offsets[d + 1] - offsets[d])
        if n < p.min_bytes:
            yield [n] if n else []
            continue
        own = mark[first[d]: first[d + 1]] - base
        ends, last = [], 0
        for c in own.tolist():
            while c - last > p.max_bytes:
                last += p.max_bytes
                ends.append(last)
            if c - last >= p.min_bytes:
                ends.append(c)
                last = c
        while n - last > p.max_bytes:
            last += p.max_bytes
            ends.append(last)
        if n > last:
            if n - last < p.min_bytes and ends:
                ends[-1] = n
            else:
                ends.append(n)
        yield ends


def _scan(p: ChunkParams):
    """One row per document: the ends of its chunks and their digests in two halves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, high, low = [], [], []
            for _, _, buf, offsets in B.blocks(batch.column("text")):
                data = buf.tobytes()
                for d, own in enumerate(cuts(buf, offsets, p)):
                    base = int(offsets[d])
                    whole = b"".join(xxhash.xxh3_128_digest(data[base + a: base + b]) for a, b in zip([0, *own], own))
                    digest = np.frombuffer(whole, "<i8").reshape(-1, 2)
                    ends.append(np.array(own, np.int32))
                    high.append(digest[:, 0])
                    low.append(digest[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array(ends, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int64())),
                 pa.array(low, pa.list_(pa.int64()))], names=["doc", "th", "ends", "high", "low"])
    return run


def chunk_table(docs: DataFrame, p: ChunkParams = ChunkParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, th, ends, high, low)`` of every document, as a written table."""
    th = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), th).alias("doc"), th.alias("th"), F.col(text).alias("text"))
    return materialize(slim.mapInArrow(_scan(p), "doc long, th long, ends array<int>, high array<long>, low array<long>"), "chunks")


def repeated_chunks(table: DataFrame) -> DataFrame:
    """``(doc, th, chunks array<int>)``: numbers of the chunks that go, for documents that lose any."""
    twice = table.select(F.explode("high").alias("high")).groupBy("high").agg(F.count("*").alias("n")).where("n > 1").select("high")
    twice = materialize(twice, "twice")
    rows = table.select("doc", "th", F.explode(F.arrays_zip("high", "low", F.sequence(F.lit(0), F.size("high") - 1).alias("at"))).alias("c")
                        ).select("doc", "th", "c.high", "c.low", "c.at")
    some = maybe_in(rows, F.col("high"), twice).where("maybe").drop("maybe")
    some = materialize(some.join(twice, "high"), "repeats")
    # written, so that the join has a plain exchange on both sides and the rows of a hot digest can be split
    kept = materialize(some.groupBy("high", "low").agg(F.min(F.struct("doc", "th", "at")).alias("kept")), "kept")
    gone = some.join(kept, ["high", "low"]).where(F.struct("doc", "th", "at") != F.col("kept"))
    return materialize(gone.groupBy("doc", "th").agg(F.collect_list("at").alias("chunks")), "gone")


def _cut(at: int, ends_at: int, gone_at: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            n_bytes, removed, n_gone, spans, kept = [], [], [], [], []
            for t, ends, gone in zip(texts, batch.column(ends_at).to_pylist(), batch.column(gone_at).to_pylist()):
                t, ends, drop = t or b"", ends or [], sorted(set(gone or ()))
                starts = [0, *ends]
                runs: list[list[int]] = []
                for k in drop:
                    if runs and runs[-1][1] == starts[k]:
                        runs[-1][1] = ends[k]
                    else:
                        runs.append([starts[k], ends[k]])
                runs = [r for r in runs if r[1] - r[0] >= min_run or r == [0, len(t)]]
                edge = [0, *[x for r in runs for x in r], len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))
                n_bytes.append(len(t))
                removed.append(len(t) - len(kept[-1]))
                n_gone.append(len(drop))
                spans.append([{"start": a, "end": b} for a, b in runs])
            skip = {ends_at, gone_at}
            columns = [c for k, c in enumerate(batch.columns) if k not in skip]
            names = [c for k, c in enumerate(batch.schema.names) if k not in skip]
            extra = [pa.array(x, pa.int64()) for x in (n_bytes, removed, n_gone)]
            extra += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *(f"{k}" for k in range(len(extra)))])
    return run


def dedup_chunks(docs: DataFrame, p: ChunkParams = ChunkParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_repeated`` (chunks that occurred before), ``spans`` and ``kept`` (bytes).

    Added names get underscores where ``docs`` has such columns.
    """
    table = chunk_table(docs, p, doc_id, text)
    gone = repeated_chunks(table)
    # the chunks of the documents that lose some; equal rows have equal chunks
    found = table.join(gone, ["doc", "th"]).dropDuplicates(["doc", "th"])
    key, th, ends, held = (fresh(docs, x) for x in ("chunk_doc", "chunk_text", "chunk_ends", "chunk_gone"))
    keyed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keyed = keyed.withColumn(key, F.coalesce(F.col(doc_id).cast("long"), F.col(th)))
    marked = maybe_in(keyed, F.col(key), gone.select("doc"))
    maybe = marked.columns[-1]
    found = found.select(F.col("doc").alias(key), F.col("th").alias(th), F.col("ends").alias(ends), F.col("chunks").alias(held))
    added = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_repeated", T.LongType()),
             ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
             ("kept", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(fresh(docs, n), t) for n, t in added]])
    n = len(docs.columns)
    hit = marked.where(maybe).join(found, [key, th], "left").select(*docs.columns, ends, held)
    none = F.lit(None).cast("array<int>")
    rest = marked.where(~F.col(maybe)).select(*docs.columns, none.alias(ends), none.alias(held))
    return hit.union(rest).mapInArrow(_cut(docs.columns.index(text), n, n + 1, p.min_run), schema)
