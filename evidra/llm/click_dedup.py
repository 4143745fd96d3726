"""Expiring deduplication of events in a stream: row-based transformWithState over hashed buckets.

An event id belongs to one of many buckets by a hash. A bucket keeps its open windows in a timing wheel: a map deadline hour -> windows, as arrays. One
event-time timer a bucket stands at its earliest slot; when it fires, all slots behind the watermark are drained and the timer is set to the next.
The watermark moves between batches, so timers fire while the batch after it is read, and what they close belongs to the batch before; a bucket that
gets rows in that batch drains its slots first.

A window opens with an event and takes every later event of its id up to SPAN hours past its start as a repeat, also one of an earlier hour; any other
event closes it and opens the next. The watermark trails the latest hour by LATE hours and a half: hours are whole, so an event is dropped exactly if its
hour is below latest - LATE, and a window expires exactly if start + SPAN is. A window that lies that far behind the bucket's own latest hour expires after
this batch for certain, whatever the other buckets hold; it is given out at once and never enters the state.

Each event is a row of the feed. A call for each row, window or slot costs a Python worker far more than what it holds, so events are packed inside the
stream: the tasks that read a batch fold equal events and make a row of arrays for each bucket, the slots of the wheel hold arrays, and closed windows leave
in arrays that Spark explodes. A task holds the events of one bucket and batch, some ROWS, and CHUNK events while it packs. Rows without id or
arrival time have no place in a window and are left out; every other column may be null.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidra.llm.common import scratch_path, ship

#: Hours that a window takes repeats after its start; hours that an event may trail the latest one; batches; rows of a bucket in one batch; events that are
#: packed at a time; windows of a row that leaves the state.
SPAN, LATE, BATCHES, ROWS, CHUNK, OUT = 24, 96, 8, 1 << 14, 1 << 19, 1 << 12
HOUR_MS = 3_600_000
WINDOW = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
_FED = "click_id long, hour long, hash binary, n long, batch int"
_CELL = pa.schema([("bucket", pa.int64()), ("last", pa.int64()), ("numbers", pa.binary()), ("hashes", pa.binary())])
_CELL_DDL = "bucket long, last long, numbers binary, hashes binary"
_CLOSED = "closed_batch long, click_id array<long>, start_hour array<long>, n_repeats array<long>, n_conflicts array<long>, conflict_crc array<long>, hash array<binary>"
#: Of the streaming session: state that Spark keeps in RocksDB, its changes written as a log, nothing left open on an executor; one
#: micro-batch a start; rows of an Arrow batch.
_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def _digests(raw: bytes) -> np.ndarray:
    """SHA-256 values one behind another as rows of four numbers that sort as their bytes do."""
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 4)


def _raw(digests: np.ndarray) -> bytes:
    return digests.astype(">u8").tobytes()


def _cells(t: pa.Table) -> pa.RecordBatch:
    """Events (bucket, click_id, hour, n, hash) as a row for each bucket, equal ones folded."""
    bucket, click, hour, n = (t.column(c).to_numpy() for c in ("bucket", "click_id", "hour", "n"))
    digest = _digests(b"".join(t.column("hash").to_pylist()))
    order = np.lexsort((digest[:, 0], hour, click, bucket))
    bucket, click, hour, n, digest = (x[order] for x in (bucket, click, hour, n, digest))
    new = np.ones(len(click), bool)
    new[1:] = (click[1:] != click[:-1]) | (hour[1:] != hour[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    n = np.add.reduceat(n, at)
    bucket, click, hour, digest = (x[at] for x in (bucket, click, hour, digest))
    edge = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
    rows = [(int(bucket[i]), int(hour[i:j].max()), np.stack([click[i:j], hour[i:j], n[i:j]]).tobytes(), _raw(digest[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CELL, strict=True)], schema=_CELL)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, click_id, hour, n, hash) to a row for each bucket of CHUNK of them: its last hour, the numbers click, hour, n of all its events, and their hashes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield _cells(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield _cells(pa.Table.from_batches(held))


#: Windows as arrays: clicks, starts, digests, and repeats, conflicts, sums of crc as the columns of one array.
Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def advance(held: Windows, click: np.ndarray, hour: np.ndarray, digest: np.ndarray, n: np.ndarray, span: int) -> tuple[Windows, np.ndarray]:
    """Open windows (one of an id) and events to all windows that were open at some time, and whether each was closed by a later event of its id."""
    order = np.lexsort((*digest.T[::-1], hour, click))
    click, hour, digest, n = (x[order] for x in (click, hour, digest, n))
    m = len(held[0])
    ids, first, rank = np.unique(click, return_index=True, return_inverse=True)
    stop = np.append(first[1:], len(click))
    # the window of each id, as its place in held, or m and the place of the event that opened it; -1: none
    now = np.full(len(ids), -1)
    by = np.argsort(held[0])
    at = np.searchsorted(held[0][by], ids)
    there = at < m
    there[there] = held[0][by[at[there]]] == ids[there]
    now[there] = by[at[there]]
    mark = np.full(len(click), -1)
    mark[first] = now
    starts, digests = np.concatenate([held[1], hour]), np.concatenate([held[2], digest])
    low = int(hour.min())
    step = int(hour.max()) - low + 2
    line = rank * step + hour - low
    closed = np.zeros(m + len(click), bool)
    opener = np.zeros(len(click), bool)
    live = np.arange(len(ids))
    while len(live):  # the next window of every id that has one more
        w = now[live]
        reach = np.where(w >= 0, np.clip(starts[w] + span - low, -1, step - 2), -1)
        end = np.searchsorted(line, live * step + reach, "right")
        more = end < stop[live]
        live, w, end = live[more], w[more], end[more]
        closed[w[w >= 0]] = True
        opener[end], mark[end], now[live] = True, m + end, m + end
    owner = mark[np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), 0))]
    counts = np.concatenate([held[3], np.zeros((len(click), 3), np.int64)])
    np.add.at(counts[:, 0], owner, n - opener)
    unlike = np.flatnonzero((digest != digests[owner]).any(axis=1))
    raw = _raw(digest[unlike]).hex()
    crc = np.array([zlib.crc32(raw[i : i + 64].encode()) for i in range(0, len(raw), 64)], np.int64)
    np.add.at(counts[:, 1], owner[unlike], n[unlike])
    np.add.at(counts[:, 2], owner[unlike], n[unlike] * crc)
    real = np.concatenate([np.ones(m, bool), opener])
    return (np.concatenate([held[0], click])[real], starts[real], digests[real], counts[real]), closed[real]


class ExpiringWindows(StatefulProcessor):
    """Closed windows of a bucket, in arrays. A row is what packer makes. batch is the number of the
    batch that is read, previous that of the last one before it that had rows: windows that the watermark has closed carry it."""

    def __init__(self, batch: int, previous: int, span: int = SPAN, late: int = LATE) -> None:
        self.batch, self.previous, self.span, self.late = batch, previous, span, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wheel = handle.getMapState("wheel", "deadline long", "clicks binary, hashes binary, counts binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        cells = [(np.frombuffer(r.numbers, np.int64).reshape(3, -1), _digests(r.hashes)) for r in rows]
        click, hour, n = np.concatenate([c[0] for c in cells], axis=1)
        # an event of no copies is a mark that moves the watermark
        keep = (hour * HOUR_MS > now) & (n > 0)
        if not keep.any():
            return
        old = {k[0]: tuple(map(bytes, v)) for k, v in self.wheel.iterator()}
        yield from self._closed([self._slot(d, v) for d, v in old.items() if d * HOUR_MS < now], self.previous)
        held = self._joined([self._slot(d, v) for d, v in old.items() if d * HOUR_MS >= now])
        held, closed = advance(held, click[keep], hour[keep], np.concatenate([c[1] for c in cells])[keep], n[keep], self.span)
        closed |= held[1] < hour[keep].max() - self.late - self.span
        yield from self._closed([tuple(x[closed] for x in held)], self.batch)
        self._keep(old, tuple(x[~closed] for x in held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        slots = sorted(k[0] for k in self.wheel.keys())
        for d in slots:
            if d * HOUR_MS < now:
                yield from self._closed([self._slot(d, self.wheel.getValue((d,)))], self.previous)
                self.wheel.removeKey((d,))
        self._wake([d for d in slots if d * HOUR_MS >= now])

    def close(self) -> None:
        pass

    def _slot(self, deadline: int, v: tuple) -> Windows:
        clicks = np.frombuffer(bytes(v[0]), np.int64)
        return clicks, np.full(len(clicks), deadline - self.span), _digests(bytes(v[1])), np.frombuffer(bytes(v[2]), np.int64).reshape(-1, 3)

    def _joined(self, parts: list[Windows]) -> Windows:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint64), np.zeros((0, 3), np.int64))
        return tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))

    def _closed(self, parts: list[Windows], batch: int) -> Iterator[Row]:
        clicks, starts, digests, counts = self._joined(parts)
        for i in range(0, len(clicks), OUT):
            raw = _raw(digests[i : i + OUT])
            cols = [x[i : i + OUT].tolist() for x in (clicks, starts, *counts.T)]
            yield Row(closed_batch=batch, **dict(zip(("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc"), cols, strict=True)), hash=[raw[k : k + 32] for k in range(0, len(raw), 32)])

    def _keep(self, old: dict[int, tuple], held: Windows) -> None:
        """Write the slots of the wheel that have changed, and the one timer. A wheel that loses most of its slots is cleared and written anew."""
        order = np.lexsort((held[0], held[1]))
        clicks, starts, digests, counts = (x[order] for x in held)
        edge = [*np.flatnonzero(np.diff(starts, prepend=starts[:1] - 1)).tolist(), len(starts)]
        slots = {int(starts[i]) + self.span: (clicks[i:j].tobytes(), _raw(digests[i:j]), counts[i:j].tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)}
        gone = old.keys() - slots.keys()
        if 2 * len(gone) > len(old):
            self.wheel.clear()
            old = {}
        else:
            for d in gone:
                self.wheel.removeKey((d,))
        for d, v in slots.items():
            if old.get(d) != v:
                self.wheel.updateValue((d,), v)
        self._wake(list(slots))

    def _wake(self, slots: list[int]) -> None:
        """Set the one timer to the earliest slot."""
        due = [min(slots) * HOUR_MS] if slots else []
        timers = list(self.handle.listTimers())
        for t in set(timers) - set(due):
            self.handle.deleteTimer(t)
        for t in set(due) - set(timers):
            self.handle.registerTimer(t)


def closed_windows(events: DataFrame, buckets: int, batch: int, previous: int, span: int = SPAN, late: int = LATE) -> DataFrame:
    """The streaming frame of windows (WINDOW) that close while the streaming frame events (click_id, hour, hash, n) is read; batch and previous mark them."""
    ship(events.sparkSession)
    rows = events.select(F.pmod(F.xxhash64("click_id"), F.lit(buckets)).alias("bucket"), "click_id", "hour", "n", "hash").mapInArrow(packed, _CELL_DDL)
    rows = rows.select("bucket", F.timestamp_seconds(F.col("last") * 3600).alias("at"), "numbers", "hashes").withWatermark("at", f"{late * 60 + 30} minutes")
    closed = rows.groupBy("bucket").transformWithState(ExpiringWindows(batch, previous, span, late), _CLOSED, "Append", "EventTime")
    each = closed.select("closed_batch", F.inline(F.arrays_zip("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc", "hash")))
    return each.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", F.lower(F.hex("hash")).alias("hash"))


def run_batches(spark: SparkSession, events: DataFrame, batches: int, buckets: int, span: int = SPAN, late: int = LATE) -> DataFrame:
    """The closed windows of events (click_id, hour, hash, n, batch), fed batch by batch to a query that is started anew for each on one checkpoint, all in a
    new folder under spark.checkpoint.dir. What is open after the last batch closes in it: its feed ends with a mark far ahead, and one more start with
    another mark lets all timers fire.

    A batch without rows closes nothing. Events of a null id are not read. A lost executor costs its tasks, a failed start can be repeated: the sink
    and the checkpoint agree on what is done. An empty table has no windows.
    """
    base = scratch_path(spark, "clicks")
    feed, staged, out = f"{base}/feed", f"{base}/staged", f"{base}/windows"
    kept = events.where("click_id IS NOT NULL AND hour IS NOT NULL")
    kept.select("click_id", "hour", "hash", "n", F.col("batch").cast("int")).write.partitionBy("batch").parquet(staged)
    last = spark.read.schema(_FED).parquet(staged).agg(F.max("hour")).first()[0]
    if last is None:
        return spark.createDataFrame([], WINDOW)
    mark = spark.range(1).select(F.lit(0).cast("long").alias("click_id"), F.lit(last + 2 * (span + late)).alias("hour"), F.unhex(F.lit("00" * 32)).alias("hash"), F.lit(0).cast("long").alias("n"))
    for b in (batches, batches + 1):
        mark.coalesce(1).write.parquet(f"{staged}/mark={b}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(feed))
    old = {k: spark.conf.get(k, None) for k in _CONF}
    previous = -1
    try:
        for b in range(batches + 1):
            rows = b >= batches - 1 or fs.exists(path(f"{staged}/batch={b}"))
            if fs.exists(path(f"{staged}/batch={b}")):
                fs.rename(path(f"{staged}/batch={b}"), path(f"{feed}/batch={b}"))
            if b >= batches - 1:
                fs.rename(path(f"{staged}/mark={b + 1}"), path(f"{feed}/batch={b + 1}"))
            ship(spark)
            for k, v in _CONF.items():
                spark.conf.set(k, v)
            stream = closed_windows(spark.readStream.schema(_FED).parquet(feed), buckets, b, previous, span, late)
            for k, v in _CONF.items():  # ship has set its own
                spark.conf.set(k, v)
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
            previous = b if rows else previous
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(WINDOW).parquet(out)


def _micros(df: DataFrame, name: str) -> Column:
    """UTC microseconds since 1970 of a timestamp column; one without a zone is read as UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(name)


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, place, hash) of the copies of each row: the stand-in for a source that sends some events again, late or altered."""
    crc = F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5).cast("long"), _micros(clicks, "ts"), F.col("props"), F.col("c") % 3]
    hour = F.expr("arrived div 3600000000") + 6 * F.col("j") * (F.col("c") % 10)
    each = clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL").withColumn("arrived", _micros(clicks, "arrived_at"))
    each = each.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod("click_id", F.lit(3))))).withColumn("c", crc).withColumn("hour", hour)
    place = F.col("hour") + F.floor(F.col("c") / 10) % 200
    return each.select("click_id", "hour", place.alias("place"), F.unhex(F.sha2(F.concat_ws("|", *map(text, parts)).cast("binary"), 256)).alias("hash"))


def op11_click_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(spark.read.parquet(f"{sf_dir}/clicks.parquet"))
    low, high, n = rows.agg(F.min("place"), F.max("place"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], WINDOW)
    batch = F.expr(f"(place - {low}) * {BATCHES} div {high - low + 1}")
    events = rows.select("click_id", "hour", "hash", F.lit(1).cast("long").alias("n"), batch.alias("batch"))
    return run_batches(spark, events, BATCHES, math.ceil(n / (BATCHES * ROWS)))


ORACLES: dict[str, str] = {}
