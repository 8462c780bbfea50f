"""Queries over event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.plans.registry import Tables, query
from folioflow.sources.shared import shared_folder
from folioflow.streaming import events as S

_E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def stream_of(t: Tables, name: str):
    """The table as a stream of files in a shared folder."""
    path = shared_folder(t.spark, name)
    getattr(t, name).write.parquet(path)
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(path)


def drained(t: Tables, df, mode: str = "append", number: str | None = None):
    """All of a stream's output as a table: each batch is written into a shared folder. number names a column with the batch's."""
    path = shared_folder(t.spark, "stream")

    def write(batch, epoch: int) -> None:
        batch.withColumn(number or "__epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = df.schema.add(number, "long") if number else df.schema
    return t.spark.read.schema(schema).parquet(f"{path}/out/epoch=*")


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, i, true AS allowed, [t] AS log FROM e WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, t) ELSE f END FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.t - 36000000000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id AS key, event_id AS event, allowed, len(log) AS current, 3 - len(log) AS remaining FROM r""")
def j1_rate_limit_sliding(t):
    return S.rate_limit_sliding(t.events, "user_id", "ts", "event_id", 3, 36000)


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, i, t AS s, 1 AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t >= r.s + 36000000000 THEN e.t ELSE r.s END, CASE WHEN e.t >= r.s + 36000000000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, event_id AS event, n <= 3 AS allowed, n AS current, greatest(0, 3 - n) AS remaining FROM r""")
def j2_rate_limit_fixed(t):
    return S.rate_limit_fixed(t.events, "user_id", "ts", "event_id", 3, 36000)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, false AS replay, CASE WHEN ok THEN t END AS s FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, coalesce(e.t < r.s + 86400000000, false), CASE WHEN coalesce(e.t < r.s + 86400000000, false) OR NOT e.ok THEN r.s ELSE e.t END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id AS event, replay FROM r""")
def j3_idempotent(t):
    return S.idempotent(t.events, ["user_id"], "ts", "event_id", 86400, F.col("event_type") != "error")


@query("SELECT user_id, event_type AS value, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND event_type <> 'error' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 2 DAY")
def j4_ttl_latest(t):
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    return S.ttl_latest(t.events, "user_id", "ts", "event_id", value, 2 * 86400, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, CASE WHEN event_type = 'error' THEN epoch_us(ts) ELSE -epoch_us(ts) END, CASE WHEN event_type = 'error' THEN event_id ELSE -event_id END) AS i FROM events) WHERE i = 1""")
def j5_latest_status(t):
    return S.latest_status(t.events, "user_id", "ts", "event_id", "event_type", ["error"])


@query("SELECT event_id, event_type, user_id FROM events")
def j6_stream_jsonl(t):
    path = shared_folder(t.spark, "jsonl")
    S.stream_jsonl(stream_of(t, "events").select("event_id", "event_type", "user_id"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.schema("event_id long, event_type string, user_id long").json(f"{path}/out")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL")
def j7_audit_windows(t):
    return S.audit_windows(t.events, "ts", "event_type", "6 hours")


@query("SELECT user_id, max(ts) AS last_activity, count(*) AS messages FROM events GROUP BY user_id")
def j8_session_activity(t):
    return drained(t, S.session_activity(stream_of(t, "events"), "user_id", "ts"), "complete")


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, i, t AS s, 1 AS n FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.t >= r.s + 36000000000 THEN e.t ELSE r.s END, CASE WHEN e.t >= r.s + 36000000000 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, count(*) FILTER (WHERE n <= 3) AS allowed FROM r GROUP BY user_id""")
def j2_rate_limit_stream(t):
    got = drained(t, S.rate_limit_fixed(stream_of(t, "events"), "user_id", "ts", "event_id", 3, 36000))
    return got.groupBy("key").agg(F.count_if("allowed").alias("allowed"))


@query("""SELECT user_id, event_type AS value, ts AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events)
WHERE i = 1 AND event_type <> 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR - INTERVAL 2 DAY""")
def j4_ttl_stream(t):
    value = F.when(F.col("event_type") != "error", F.col("event_type"))
    changes = S.ttl_changes(stream_of(t, "events"), "user_id", "ts", "event_id", value, 2 * 86400, "6 hours")
    return S.ttl_view(drained(t, changes, "update", "epoch"), "user_id", "epoch")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, false AS replay, CASE WHEN ok THEN t END AS s FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, coalesce(e.t < r.s + 86400000000, false), CASE WHEN coalesce(e.t < r.s + 86400000000, false) OR NOT e.ok THEN r.s ELSE e.t END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id AS event, replay FROM r""")
def j3_idempotent_stream(t):
    return drained(t, S.idempotent(stream_of(t, "events"), ["user_id"], "ts", "event_id", 86400, F.col("event_type") != "error"))


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, i, true AS allowed, [t] AS log FROM e WHERE i = 1
 UNION ALL SELECT user_id, event_id, i, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, t) ELSE f END FROM (SELECT e.*, list_filter(r.log, lambda x: x > e.t - 36000000000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id AS key, event_id AS event, allowed, len(log) AS current, 3 - len(log) AS remaining FROM r""")
def j1_rate_limit_stream(t):
    return drained(t, S.rate_limit_sliding(stream_of(t, "events"), "user_id", "ts", "event_id", 3, 36000))
