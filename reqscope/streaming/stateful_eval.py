"""Running evaluation with arbitrary state (K1): rows delivered twice count once, idle runs give their state back.

``running_eval`` adds up whatever arrives and rewrites all runs each batch. Here each
run is divided into ``parts`` by a hash of the row ids, so that a run with most of the
rows is many groups, and each (run, part) keeps

- ``attempt``, and the counts ``tn, fp, fn, tp, n`` of that attempt;
- ``seen``: the row ids counted, as bitmaps of 4,096 neighbouring ids each. A batch
  reads and writes a page once, not a row at a time;
- a timer: ``idle_ms`` after the last row of a part, its counts and row ids go, and
  only the number of the closed attempt stays, for ``forget_ms`` more.

Defined results. A row of a higher attempt starts the part again; rows of a lower one
are passed over. Of rows with one id in one attempt the first counts; rows without an
id all count. A null attempt is 0, a null key a key of its own. Rows of a closed
attempt are passed over as long as it is remembered, so ``idle_ms`` must exceed the
longest pause of a run that still delivers, and ``forget_ms`` the latest re-delivery.

Each batch writes only the parts that changed (``delta/epoch=N``). Every
``compact_every`` epochs the newest row of every part goes into one table
(``base/epoch=N``), and the deltas it covers go. A replayed batch rewrites its own
folder. A part whose row came from a lower attempt than another part's is void: the
run's result is the sum over the parts of its highest attempt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.metrics import metric_columns
from ..operators.evaluate import RUN_KEYS
from .running_eval import INSTANCE_SCHEMA

PAGE_BITS = 12
CELLS = ["tn", "fp", "fn", "tp"]
_COUNTS = "attempt bigint, tn bigint, fp bigint, fn bigint, tp bigint, n bigint"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunPart(StatefulProcessor):
    """Counts of one part of one run; see the module docstring."""

    def __init__(self, keys: list[str], idle_ms: int, forget_ms: int):
        self.keys, self.idle_ms, self.forget_ms = keys, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", _COUNTS)
        self.seen = handle.getMapState("seen", "page bigint", "bits binary")
        self.closed = handle.getValueState("closed", "attempt bigint", ttlDurationMs=self.forget_ms)

    def _unseen(self, ids: np.ndarray) -> np.ndarray:
        """Which of the distinct ``ids`` are new; marks them as seen."""
        new = np.zeros(len(ids), bool)
        pages = ids >> PAGE_BITS
        for page in np.unique(pages):
            at = np.flatnonzero(pages == page)
            held = self.seen.getValue((int(page),)) if self.seen.containsKey((int(page),)) else None
            bits = np.zeros(1 << PAGE_BITS, np.uint8) if held is None else np.unpackbits(np.frombuffer(held[0], np.uint8))
            slots = ids[at] & ((1 << PAGE_BITS) - 1)
            new[at] = bits[slots] == 0
            bits[slots] = 1
            self.seen.updateValue((int(page),), (np.packbits(bits).tobytes(),))
        return new

    def handleInputRows(self, key, rows, timerValues):
        closed = self.closed.get()[0] if self.closed.exists() else None
        now = list(self.counts.get()) if self.counts.exists() else None
        changed = False
        for chunk in rows:
            if closed is not None:
                chunk = chunk[chunk["attempt"] > closed]
            if not len(chunk):
                continue
            newest = int(chunk["attempt"].max())
            if now is None or newest > now[0]:
                self.seen.clear()
                now = [newest, 0, 0, 0, 0, 0]
            chunk = chunk[chunk["attempt"] == now[0]]
            named = chunk["req_id"].notna()
            rest = chunk[named].drop_duplicates("req_id")
            if len(rest):
                rest = rest[self._unseen(rest["req_id"].to_numpy(np.int64))]
            counted = pd.concat([rest, chunk[~named]])["cell"].to_numpy()
            if len(counted):
                changed = True
                for i in range(4):
                    now[1 + i] += int((counted == i).sum())
                now[5] += len(counted)
        if changed:
            self.counts.update(tuple(now))
        if now is not None:  # any row of an open attempt, new or not, puts the timer off
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if changed:
            yield pd.DataFrame([[*key, *now]], columns=[*self.keys, "part", "attempt", *CELLS, "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.counts.exists():
            self.closed.update((self.counts.get()[0],))
        self.counts.clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def changed_parts(stream: DataFrame, keys=RUN_KEYS, parts: int = 64, idle_ms: int = 3_600_000, forget_ms: int = 604_800_000) -> DataFrame:
    """Stream of (run, part, attempt, counts): one row for every part that a batch changed."""
    t, p = F.col("y_true"), F.col("y_pred")
    page = F.coalesce(F.shiftright("req_id", PAGE_BITS), F.hash(t, p).cast("bigint"))  # a replayed row must meet its part again
    rows = stream.select(
        *keys,
        F.pmod(F.xxhash64(page), F.lit(parts)).cast("int").alias("part"),
        F.coalesce(F.col("attempt"), F.lit(0)).cast("bigint").alias("attempt"),
        "req_id",
        # the place in CELLS; a row without truth or answer is in none, and counts in n
        F.when(t.isin(0, 1) & p.isin(0, 1), 2 * t + p).otherwise(-1).cast("int").alias("cell"),
    )
    group = [*keys, "part"]
    out = T.StructType([*[rows.schema[c] for c in group], *T._parse_datatype_string(_COUNTS).fields])
    return rows.groupBy(*group).transformWithStateInPandas(
        RunPart(list(keys), idle_ms, forget_ms), out, outputMode="Update", timeMode="ProcessingTime")


def _folders(spark: SparkSession, out_path: str, kind: str) -> dict:
    """Epoch -> folder of the finished tables of a kind."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_path}/{kind}/epoch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return {int(f.getPath().getParent().getName().partition("=")[2]): f.getPath().getParent() for f in found}


def _newest_parts(spark: SparkSession, out_path: str, keys, last: int | None = None) -> DataFrame:
    """The newest row of every part up to epoch ``last``: the newest base and the deltas after it."""
    bases, deltas = _folders(spark, out_path, "base"), _folders(spark, out_path, "delta")
    base = max((e for e in bases if last is None or e <= last), default=-1)
    paths = [bases[base]] if base >= 0 else []
    paths += [d for e, d in sorted(deltas.items()) if e > base and (last is None or e <= last)]
    if not paths:
        raise FileNotFoundError(f"no finished epoch under {out_path}")
    rows = spark.read.parquet(*[p.toString() for p in paths])
    cells = F.struct("attempt", "epoch_no", *CELLS, "n")  # attempts first: a part never falls back
    return rows.groupBy(*keys, "part").agg(F.max(cells).alias("c")).select(*keys, "part", "c.*")


def read_results(spark: SparkSession, out_path: str, keys=RUN_KEYS) -> DataFrame:
    """Run results (T2) as of the newest finished epoch: the sum over the parts of each run's highest attempt."""
    by_attempt = _newest_parts(spark, out_path, keys).groupBy(*keys, "attempt").agg(*[F.sum(c).alias(c) for c in [*CELLS, "n"]])
    last = by_attempt.groupBy(*keys).agg(F.max_by(F.struct(*CELLS, "n"), "attempt").alias("c")).select(*keys, "c.*")
    return last.select(*keys, *metric_columns(), *CELLS, F.col("n").alias("n_test"))


PARTITION_ROWS = 4_000_000  # of a first delivery that one state partition takes, about


def layout(rows: int, partitions: int) -> dict[str, int]:
    """``parts`` and ``state_partitions`` of :func:`start` for a first delivery of ``rows`` rows; ``partitions`` are the least.

    Neither a state partition's rows nor those of a part of the largest run grow with the delivery.
    """
    n = max(partitions, -(-rows // PARTITION_ROWS))
    return {"parts": max(4, n // 2), "state_partitions": n}


def start(
    spark: SparkSession, source_dir: str, out_path: str, checkpoint: str, keys=RUN_KEYS, schema: str = INSTANCE_SCHEMA,
    files_per_trigger: int | None = None, available_now: bool = True, state_partitions: int | None = None,
    parts: int = 64, idle_ms: int = 3_600_000, forget_ms: int = 604_800_000, compact_every: int = 20,
) -> StreamingQuery:
    """Start the evaluation. ``state_partitions`` and ``parts`` are fixed by the first run of a checkpoint.

    ``available_now`` drains what has arrived and stops; timers that fall due later go off in the next call.
    The state store and the partition count are settings of this query only: the stream copies the session's
    settings when it starts, and the session's own values are restored right after.
    """
    keys = list(keys)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    changed = changed_parts(reader.parquet(source_dir), keys, parts, idle_ms, forget_ms)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch_no", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{out_path}/delta/epoch={epoch}")
        if (epoch + 1) % compact_every == 0:
            _newest_parts(spark, out_path, keys, epoch).write.mode("overwrite").parquet(f"{out_path}/base/epoch={epoch}")
            # what the base before this one covers goes; a reader may still hold this base's own deltas
            bases = sorted(_folders(spark, out_path, "base"))
            for kind, limit in (("delta", bases[-2] if len(bases) > 1 else -1), ("base", bases[-2] - 1 if len(bases) > 1 else -1)):
                for e, folder in _folders(spark, out_path, kind).items():
                    if e <= limit:
                        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    w = changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB}
    if available_now:  # timers alone would keep a draining query alive for ever; they go off with its next batch of rows
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(int(state_partitions))
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
