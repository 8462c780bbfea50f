"""Streams against the batch forms: hot and null keys, restarts, keys that nearly agree, expiry at several times."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.streaming import events as S

BIG = 2**53


def frame(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"event long, key {kind}, us long, ok boolean").withColumn("ts", F.timestamp_micros("us")).drop("us")


CASES = {
    "sliding": lambda x: S.rate_limit_sliding(x, "key", "ts", "event", 3, 100),
    "fixed": lambda x: S.rate_limit_fixed(x, "key", "ts", "event", 3, 100),
    "once": lambda x: S.idempotent(x, ["key", "other"], "ts", "event", 200, F.col("ok")),
}


def events_in_order(n):
    """A third of the events are one key's; null keys, and keys that are one as doubles."""
    rnd = random.Random(3)
    us, rows = 10**15, []
    for i in range(n):
        us += rnd.randrange(30 * 10**6)
        key = 7 if i % 3 == 0 else rnd.choice([None, BIG, BIG + 1, -5])
        rows.append((i, key, us, rnd.random() < 0.7))
    return rows


@pytest.mark.parametrize("name", sorted(CASES))
def test_restarted_stream_equals_batch(spark, tmp_path, name):
    rows = events_in_order(600)
    make = lambda x: CASES[name](x.withColumn("other", F.when(F.col("event") % 2 == 0, "x")))
    schema = frame(spark, rows).schema
    for k in range(3):  # the query ends and starts again from its checkpoint
        frame(spark, rows[200 * k : 200 * (k + 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = make(frame(spark, rows)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == 600


def test_null_keys_are_limited_like_others(spark):
    rows = [(i, None, 10**15 + i, True) for i in range(3)] + [(3, BIG, 10**15, True), (4, BIG + 1, 10**15, True), (5, 1, None, True)]
    for made in (S.rate_limit_sliding, S.rate_limit_fixed):
        got = {r.event: (r.key, r.allowed) for r in made(frame(spark, rows), "key", "ts", "event", 2, 60).collect()}
        assert got == {0: (None, True), 1: (None, True), 2: (None, False), 3: (BIG, True), 4: (BIG + 1, True)}
    nan = frame(spark, [(i, float("nan"), 10**15 + i, True) for i in range(3)], "double")
    assert [r.allowed for r in S.rate_limit_sliding(nan, "key", "ts", "event", 2, 60).orderBy("event").collect()] == [True, True, False]


def test_parts_of_a_key_are_compared_one_by_one(spark):
    rows = [(0, "x", None), (1, None, "x"), (2, "x", None), (3, "a\u001fb", "c"), (4, "a", "b\u001fc"), (5, None, None), (6, None, None)]
    df = spark.createDataFrame(rows, "event long, a string, b string").withColumn("ts", F.timestamp_seconds(F.lit(10**9) + F.col("event")))
    got = {r.event: r.replay for r in S.idempotent(df, ["a", "b"], "ts", "event", 3600, F.lit(True)).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False, 6: True}


@pytest.mark.parametrize("late", [0, 50, 400])
def test_view_of_last_values_at_several_times(spark, tmp_path, late):
    rnd = random.Random(late)
    rows = [(i, rnd.choice([None, BIG, BIG + 1, 1, 2, 3]), 10**15 + rnd.randrange(1000) * 10**6 + i % 3, rnd.random() < 0.8) for i in range(200)]
    df = frame(spark, rows)
    value = F.when(F.col("ok"), F.concat(F.lit("v"), F.col("event")))
    df.write.parquet(str(tmp_path / "in"))
    changes = S.ttl_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "ts", "event", value, 40, f"{late} seconds")

    def write(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(str(tmp_path / "out" / f"e={epoch}"))

    changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "e=*"))
    now = max(r[2] for r in rows) // 1000 * 1000 - late * 10**6  # the watermark, in milliseconds
    want = S.ttl_latest(df, "key", "ts", "event", value, 40, F.timestamp_micros(F.lit(now)))
    assert {(r.key, r.value, r["at"]) for r in S.ttl_view(out, "key", "epoch").collect()} == {(r.key, r.value, r["at"]) for r in want.collect()}
    assert late or out.filter("not live").count() > 0
