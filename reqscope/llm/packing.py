"""Best-fit packing of tokenised documents into fixed-length sequences by the
sum-of-squares rule: a piece goes where the sum of squared counts of open
sequences per residual gap becomes smallest.

A document is its token ids and one closing id. Only documents longer than a
sequence are cut: into full pieces, the first of which holds the rest and may
be shorter. Full pieces are sequences of their own. The others are dealt by
hash to shards of about ``shard_pieces`` pieces, each packed by one
task that holds lengths only (long pieces first, :func:`arrival`), so work and memory per task do not grow with
the corpus; each shard leaves a handful of sequences part-filled.

Defined results: a null or empty text is the closing id alone; an empty table
gives no rows; equal rows are packed each. Null ids of documents stay null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Texts in which both tokenizer libraries split words alike: ASCII and Latin letters with marks.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """``text -> uint32 ids`` for a tokenizer file, special tokens not added.

    A byte-level BPE whose merge order is its id order gives the same ids in
    either library; the faster one then encodes plain texts, and the file's own
    library encodes the others.
    """
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    own = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    like = (
        model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        and not spec.get("normalizer") and not spec.get("post_processor") and not model.get("dropout") and not model.get("ignore_merges"))
    if not like:
        return slow
    letters, special = _byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {w: i for w, i in model["vocab"].items() if w not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or any(c not in letters for w in vocab for c in w):
        return slow
    import public_tokenizers
    import tiktoken

    ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items()}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={x["content"]: x["id"] for x in spec.get("added_tokens", [])})

    def encode(text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text):
            return fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        return slow(text)

    return encode


def cut(n_ids: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; the first holds what the full ones leave."""
    rest = n_ids % size
    first = [(0, rest)] if rest else []
    return first + [(at, size) for at in range(rest, n_ids, size)]


def tokenize_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = 2048, end_id: int = 0,
                    doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` for every piece of every document."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                own = np.append(encode(value or ""), np.uint32(end_id)).astype("<u4")
                for p, (at, n) in enumerate(cut(len(own), size)):
                    part = own[at: at + n]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if ids:
                        held.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the given order.

    ``open_at[g]`` counts the open sequences with gap ``g``. Using gap ``g`` for
    a piece of length ``s`` changes the sum of squares by
    ``2 * (open_at[g - s] - open_at[g]) + 2`` (closing one: ``1 - 2 * open_at[s]``;
    a new one: ``2 * open_at[size - s] + 1``). Ties go to the smallest gap.
    """
    open_at = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    seq, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        change = 2 * (open_at[: size - s] - open_at[s:size]) + 2  # by gap s .. size - 1
        change[:1] = 1 - 2 * open_at[s]  # an exact fit closes a sequence
        change[open_at[s:size] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        if not len(change) or change[best] > 2 * open_at[size - s] + 1:
            gap, mine = size, used
            used += 1
        else:
            gap = s + best
            mine = stacks[gap].pop()
            open_at[gap] -= 1
        seq[k], offset[k] = mine, size - gap
        if gap > s:
            stacks[gap - s].append(mine)
            open_at[gap - s] += 1
    return seq, offset


def arrival(lengths: np.ndarray, uids: np.ndarray, size: int) -> np.ndarray:
    """The order in which pieces are placed: those over a quarter of a sequence longest first, then the others mixed.

    The rule is at its best on small pieces that come in no order; long ones
    must come first, or no gap is left that fits them.
    """
    long = lengths > size // 4
    mixed = (uids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return np.lexsort((uids, mixed, np.where(long, -lengths, 0)))


def plan(pieces: DataFrame, size: int = 2048, shard_pieces: int = 65_536) -> DataFrame:
    """``(uid, sequence_id, offset)`` for pieces ``(uid, length)``; ``pieces`` must be a written table."""
    short = pieces.where(F.col("length") < size).select("uid", "length")
    shards = max(1, -(-short.count() // shard_pieces))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[arrival(pdf["length"].to_numpy(), pdf["uid"].to_numpy(), size)]
        seq, offset = sum_of_squares(pdf["length"].to_numpy(), size)
        # odd numbers, apart from the even ones of full pieces; a shard holds far fewer than 2**32 sequences
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "sequence_id": ((int(key[0]) << 32) + seq) * 2 + 1, "offset": offset})

    packed = (short.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
              .groupBy("shard").applyInPandas(run, "uid long, sequence_id long, offset long"))
    full = pieces.where(F.col("length") >= size).select("uid", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = 2048, end_id: int = 0,
                   doc_id: str = "doc_id", text: str = "text", ids: bool = True, shard_pieces: int = 65_536) -> DataFrame:
    """Every piece with its ids (unless ``ids=False``), ``sequence_id`` and ``offset`` in that sequence."""
    pieces = tokenize_pieces(docs, tokenizer, size, end_id, doc_id, text, ids)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(plan(pieces, size, shard_pieces), "uid").drop("uid")
