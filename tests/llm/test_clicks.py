"""Expiring click deduplication against a plain loop."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import zlib

import duckdb
import pytest

from evidra.llm import click_dedup as cd

EPOCH = dt.datetime(1970, 1, 1)


def brute_copies(rows):
    """(click_id, hour, place, hash) of (click_id, ts, arrived_at, client_id, kind, value, props) rows."""
    out = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        for j in range(click % 3 + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = (arrived - EPOCH) // dt.timedelta(hours=1) + 6 * j * (c % 10)
            amount = None if value is None else int((100 * value + 0.5) // 1)
            micros = None if ts is None else (ts - EPOCH) // dt.timedelta(microseconds=1)
            text = "|".join("" if x is None else str(x) for x in (client, kind, amount, micros, props, c % 3))
            out.append((click, hour, hour + c // 10 % 200, hashlib.sha256(text.encode()).hexdigest()))
    return out


def brute_windows(events, batches, span=cd.SPAN, late=cd.LATE):
    """Closed windows of (click_id, hour, hash, batch) events, by the contract."""
    opened, closed, latest = {}, [], None
    for b in range(batches):
        mine = sorted((c, h, x) for c, h, x, k in events if k == b and (latest is None or h >= latest - late))
        for c, h, x in mine:
            w = opened.get(c)
            if w and h <= w[1] + span:
                w[3] += 1
                if x != w[6]:
                    w[4] += 1
                    w[5] += zlib.crc32(x.encode())
            else:
                if w:
                    closed.append((*w[:2], b, *w[3:]))
                opened[c] = [c, h, None, 0, 0, 0, x]
        latest = max([h for _, h, _, k in events if k == b] + ([latest] if latest is not None else []), default=None)
        for c in [c for c, w in opened.items() if b == batches - 1 or (latest is not None and w[1] + span < latest - late)]:
            w = opened.pop(c)
            closed.append((*w[:2], b, *w[3:]))
    return sorted(closed)


def got(df):
    return sorted(tuple(r) for r in df.select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash").collect())


def test_query_equals_loop(spark, sf):
    rows = duckdb.sql(f"SELECT click_id, ts, arrived_at, client_id, kind, value, props FROM '{sf}/clicks.parquet'").fetchall()
    copies = brute_copies(rows)
    low, high = min(c[2] for c in copies), max(c[2] for c in copies)
    events = [(c, h, x, (p - low) * 8 // (high - low + 1)) for c, h, p, x in copies]
    want = brute_windows(events, 8)
    assert got(cd.op11_click_dedup(spark, sf)) == want
    assert any(w[3] for w in want) and any(w[4] for w in want) and len({w[2] for w in want}) > 5


@pytest.mark.parametrize("seed", range(2))
def test_few_ids_many_events(spark, seed):
    """Hot ids, late events, hours before the window's start, equal copies, a batch without rows, several buckets."""
    rng = random.Random(seed)
    events = []
    for b in (0, 1, 3, 4):
        for _ in range(200):
            h = 480_000 + 70 * b + rng.randrange(-120, 60)
            events.append((rng.choice([1, 1, 1, 2, 3, *range(50, 110)]), h, hashlib.sha256(bytes([rng.randrange(3)])).hexdigest(), b))
    df = spark.createDataFrame([(c, h, bytes.fromhex(x), 1, b) for c, h, x, b in events] + [(None, 480_001, b"", 1, 0), (9, None, b"", 1, 0)], "click_id long, hour long, hash binary, n long, batch int")
    folded = df.groupBy("click_id", "hour", "hash", "batch").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    assert got(cd.run_batches(spark, folded, 5, 30)) == brute_windows(events, 5)


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour long, bucket string, n int"
    at = dt.datetime(2024, 1, 1, 5, 59, 59)
    rows = [
        (3, None, at, None, None, None, None, 1, "x", 2),
        (3, None, at, None, None, None, None, 1, "x", 2),
        (5, at, at, 7, "a|b", -0.005, "{}", 1, "x", 2),
        (None, at, at, 7, "k", 1.0, "{}", 1, "x", 2),
        (8, at, None, 7, "k", 1.0, "{}", 1, "x", 2),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/clicks.parquet")
    copies = brute_copies([r[:7] for r in rows])
    low, high = min(c[2] for c in copies), max(c[2] for c in copies)
    want = brute_windows([(c, h, x, (p - low) * 8 // (high - low + 1)) for c, h, p, x in copies], 8)
    assert got(cd.op11_click_dedup(spark, f"{tmp_path}/a")) == want
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/clicks.parquet")
    assert cd.op11_click_dedup(spark, f"{tmp_path}/b").collect() == []


def test_every_event_is_a_row_of_the_feed(spark):
    """The stream reads single events, several starts on one checkpoint; the state packs them."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Fed(StreamingQueryListener):
        def __init__(self):
            self.rows = {}

        def onQueryStarted(self, event):
            self.rows.setdefault((str(event.id), str(event.runId)), 0)

        def onQueryProgress(self, event):
            self.rows[str(event.progress.id), str(event.progress.runId)] += event.progress.numInputRows

        def onQueryTerminated(self, event):
            pass

    events = [(c, 480_000 + 60 * b + c % 7, bytes([c % 256]) * 32, 1, b) for c in range(1500) for b in range(3)]
    df = spark.createDataFrame(events, "click_id long, hour long, hash binary, n long, batch int").repartition(3)
    fed = Fed()
    spark.streams.addListener(fed)
    try:
        windows = got(cd.run_batches(spark, df, 3, 2))
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(fed)
    assert windows == brute_windows([(c, h, x.hex(), b) for c, h, x, _, b in events], 3)
    assert len({i for i, _ in fed.rows}) == 1 and len(fed.rows) == 4 and len(events) <= sum(fed.rows.values()) <= len(events) + 2
