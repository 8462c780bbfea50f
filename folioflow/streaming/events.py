"""Event streams: limiters, idempotency, expiry and activity (J1-J8). Event time stands for the wall clock."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.batches import arrow_types, same
from folioflow.streaming.state import Fixed, InOrder, Latest, Once, Sliding, run_stateful


def fold_by_key(df: DataFrame, keys: list[str], rule, schema: str) -> DataFrame:
    """Each key's rows (us, event, ok) in order through the rule.

    Rows are dealt by key, sorted within the partition by Spark and read in Arrow batches, so a key of any number of
    rows needs only its state in memory. Null keys are a key like any other.
    """
    types, n = arrow_types(schema), len(keys)
    with_key = len(keys) == 1 and rule.names[0] == "key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, step = None, None, rule.step
        for b in batches:
            answers = []
            given = [b.column(i).to_pylist() for i in range(n)]
            for *key, us, ok in zip(*given, b.column("us").to_pylist(), b.column("ok").to_pylist(), strict=True):
                if state is None or not all(map(same, key, own)):
                    own, state = key, []
                answers.append(step(state, us, ok))
            if answers:
                passed = [b.column(0), b.column("event")] if with_key else [b.column("event")]
                made = [pa.array(x, t) for x, t in zip(zip(*answers, strict=True), types[len(passed) :], strict=True)]
                yield pa.RecordBatch.from_arrays(passed + made, names=list(rule.names))

    rows = df.select(*keys, "event", "us", "ok")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "us", "event").mapInArrow(run, schema)


_LIMITS = "key {kind}, event long, allowed boolean, current long, remaining long"


def _stepped(df: DataFrame, keys: list[Column], ts: str, event: str, ok: Column, rule, schema: str, keep_us: int, late: str) -> DataFrame:
    """Each key's events in order through a rule, batch or stream. Events without a time are left out.

    A stream takes a key's events of a micro-batch in order, drops those later than the watermark, and forgets a key
    once the watermark is keep_us past its last event, so that state holds the keys of that time alone. It answers at
    once; where all of a key's events come in order of time, it answers as the batch form does.
    """
    names = [f"k{i}" for i in range(len(keys))]
    at = F.col(ts).cast("timestamp")
    rows = df.filter(at.isNotNull()).select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col(event).cast("long").alias("event"), F.unix_micros(at).alias("us"), ok.alias("ok"), *([at.alias("at")] if df.isStreaming else []))
    schema = schema.format(kind=rows.schema["k0"].dataType.simpleString())
    if not df.isStreaming:
        return fold_by_key(rows, names, rule, schema)
    return run_stateful(rows.withWatermark("at", late), names, InOrder(rule, keep_us), schema)


def rate_limit_sliding(df: DataFrame, key: str, ts: str, event: str, limit: int, window_s: int, late: str = "1 hour") -> DataFrame:
    """An event is allowed while fewer than limit allowed ones of its key lie in the window before it; batch or stream.

    A stream keeps the allowed times within the window for each key (limit at most).
    """
    us = window_s * 1_000_000
    return _stepped(df, [F.col(key)], ts, event, F.lit(True), Sliding(limit, us), _LIMITS, us, late)


def rate_limit_fixed(df: DataFrame, key: str, ts: str, event: str, limit: int, window_s: int = 60, late: str = "1 hour") -> DataFrame:
    """A window opens at a key's first event and lasts window_s; the first limit events in it are allowed. Batch or stream."""
    us = window_s * 1_000_000
    return _stepped(df, [F.col(key)], ts, event, F.lit(True), Fixed(limit, us), _LIMITS, us, late)


def idempotent(df: DataFrame, key: list[str], ts: str, event: str, ttl_s: int, success: Column, late: str = "1 hour") -> DataFrame:
    """(event, replay): whether a stored success of the key is not older than ttl; only successes that are no replays are stored. Batch or stream.

    The parts of a key are compared one by one: null and another's null are the same part, and (x, null) isn't (null, x).
    """
    us = ttl_s * 1_000_000
    return _stepped(df, [F.col(k) for k in key], ts, event, F.coalesce(success, F.lit(False)), Once(us), "event long, replay boolean", us, late)


def ttl_changes(df: DataFrame, key: str, ts: str, event: str, value: Column, ttl_s: int, late: str = "1 hour") -> DataFrame:
    """J4 as a stream: key, value, at, live: a row for each change of a key's last value, and one with live false when it is revoked or ttl is over.

    Out of date is decided by timers in event time, at the watermark; the text of the value is kept. Events without a
    time are left out.
    """
    at = F.col(ts).cast("timestamp")
    rows = df.filter(at.isNotNull()).select(F.col(key).alias("k0"), F.col(event).cast("long").alias("event"), F.unix_micros(at).alias("us"), value.cast("string").alias("value"), at.alias("at"))
    kind = rows.schema["k0"].dataType.simpleString()
    made = run_stateful(rows.withWatermark("at", late), ["k0"], Latest(ttl_s * 1_000_000), f"key {kind}, value string, at_us long, live boolean", "update")
    return made.select(F.col("key").alias(key), "value", F.timestamp_micros("at_us").alias("at"), "live")


def ttl_view(changes: DataFrame, key: str, batch: str) -> DataFrame:
    """The values that are live after all changes written so far; batch numbers their micro-batches."""
    # a key's own changes of one micro-batch are in order of time, and one that ends a value comes first
    last = changes.groupBy(key).agg(F.max_by(F.struct("value", "at", "live"), F.struct(batch, "at", "live")).alias("r")).select(key, "r.*")
    return last.filter("live").select(key, "value", "at")


def ttl_latest(df: DataFrame, key: str, ts: str, event: str, value: Column, ttl_s: int, now: Column) -> DataFrame:
    """The last value of each key if it is within ttl of now; a null value revokes."""
    last = df.groupBy(key).agg(F.max_by(F.struct(value.alias("value"), F.col(ts).alias("at")), F.struct(ts, event)).alias("r")).select(key, "r.*")
    return last.filter(F.col("value").isNotNull() & (F.col("at") > now - F.expr(f"INTERVAL {ttl_s} SECONDS")))


def latest_status(df: DataFrame, key: str, ts: str, event: str, status: str, final: list[str]) -> DataFrame:
    """Each job's latest status, none after its first final one; batch or stream (update mode), as one aggregate."""
    at = F.struct(ts, event, status)
    best = df.groupBy(key).agg(F.coalesce(F.min(F.when(F.col(status).isin(final), at)), F.max(at)).alias("r"))
    return best.select(key, f"r.{status}", f"r.{event}")


def stream_jsonl(df: DataFrame, path: str, checkpoint: str):
    """Appends the stream's records as JSON lines as batches finish; exactly once by the checkpoint."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def audit_windows(df: DataFrame, ts: str, category: str, window: str, late: str = "1 hour") -> DataFrame:
    """Events and errors of each category and tumbling window; later ones than the watermark are dropped."""
    own = df.withWatermark(ts, late) if df.isStreaming else df
    return own.groupBy(F.window(ts, window).alias("w"), category).agg(F.count("*").alias("n"), F.count_if(F.col(category) == "error").alias("errors")).select(F.col("w.start").alias("start"), category, "n", "errors")


def session_activity(df: DataFrame, session: str, ts: str) -> DataFrame:
    """Messages and last activity of each session; batch or stream."""
    return df.groupBy(session).agg(F.max(ts).alias("last_activity"), F.count("*").alias("messages"))
