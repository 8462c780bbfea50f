"""Queries over memories, sessions, versions and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.operators import memory as M
from folioflow.operators import reports as P
from folioflow.plans.registry import query


def _memories(t):
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("user"), F.substring("text", 1, 12).alias("title"), "text", F.when(F.col("turn") % 3 == 0, "deprecated").otherwise("active").alias("status"),
        F.array("role").alias("tags"), F.col("turn").cast("long").alias("created"), ((F.col("turn") % 5) / 10).alias("importance"),
    )


_M = "(SELECT conv_id * 1000 + turn AS id, conv_id AS user, substr(text, 1, 12) AS title, text, CASE WHEN turn % 3 = 0 THEN 'deprecated' ELSE 'active' END AS status, role, turn::BIGINT AS created, (turn % 5) / 10 AS importance FROM conversations)"


@query(f"SELECT id FROM {_M} WHERE user = 7 AND status = 'active' AND role IN ('user', 'assistant') ORDER BY created DESC, id LIMIT 50")
def b12_search_memories(t):
    return M.search_memories(_memories(t), user=7, status="active", tags=["user", "assistant"]).select("id")


@query("SELECT event_id FROM events WHERE user_id % 2 = 0 OR ts > TIMESTAMP '2024-01-15 00:00:00'")
def b13_not_expired(t):
    expires = F.when(F.col("user_id") % 2 == 1, F.col("ts"))
    return t.events.filter(M.not_expired(expires, F.lit("2024-01-15 00:00:00").cast("timestamp"))).select("event_id")


@query(f"SELECT user, role, max_by(id, created * 1000000 + id) AS id FROM {_M} WHERE status = 'active' GROUP BY user, role")
def e2_latest_active(t):
    rows = _memories(t).withColumn("role", F.col("tags")[0])
    return M.latest_active(rows, ["user", "role"], "created", "id").select("user", "role", "id")


_OLD = f"o AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY created, id) AS r FROM {_M} WHERE 100 - created > 95 AND importance <= 0.3), c AS (SELECT * FROM o WHERE r <= 3)"


@query(f"WITH {_OLD} SELECT id, user, text FROM {_M} WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT min(id), user, substr(string_agg(text, chr(10) ORDER BY created, id), 1, 500) FROM c GROUP BY user")
def d11_compact_memories(t):
    kept, _ = M.compact_memories(_memories(t).drop("tags", "title", "status"), 100, days=95, most=3)
    return kept.select("id", "user", "text")


@query("SELECT count(*) FILTER (WHERE user_id % 2 = 1 AND ts <= TIMESTAMP '2024-01-15 00:00:00') AS expired FROM events")
def d12_expire(t):
    rows = t.events.withColumn("expires", F.when(F.col("user_id") % 2 == 1, F.col("ts")))
    return M.expire(rows, "expires", F.lit("2024-01-15 00:00:00").cast("timestamp"))[1]


@query("""SELECT coalesce(a.u, b.u, c.u) AS user_id, coalesce(a.n, 0) AS sessions, coalesce(b.n, 0) AS memories, coalesce(c.n, 0) AS structures FROM
(SELECT user_id AS u, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a FULL JOIN (SELECT user_id AS u, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.u = b.u FULL JOIN (SELECT o_custkey AS u, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) c ON c.u = coalesce(a.u, b.u)""")
def d6_user_stats(t):
    kind = lambda k: t.events.filter(F.col("event_type") == k).select("user_id")
    return M.user_stats(kind("view"), kind("click"), t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("user_id")), "user_id")


@query("SELECT conv_id, string_agg(role || text, '|' ORDER BY turn) AS messages, max(turn) AS last_activity FROM conversations GROUP BY conv_id")
def d14_session_view(t):
    got = M.session_view(t.conversations, "conv_id", "turn", ["role", "text"], "turn")
    return got.withColumn("messages", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["text"])), "|"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 1 AND o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def f1_list_by_user(t):
    return P.newest(t.orders, (F.col("o_custkey") == 1) & (F.col("o_orderstatus") == "O"), "o_orderdate", "o_orderkey", 30).select("o_orderkey")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 25")
def f3_user_sessions(t):
    return P.user_sessions(t.events, "user_id", "ts", 25)


@query("SELECT c_custkey AS id, 1 + n AS access_count, greatest(0, last) AS last_accessed FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 1, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j9_apply_access(t):
    memories = t.customer.select(F.col("c_custkey").alias("id"), F.lit(1).alias("access_count"), F.lit(0).cast("long").alias("last_accessed"))
    return M.apply_access(memories, t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("long").alias("at")), "id", "at")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'deprecated' ELSE 'active' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 10000000 END AS replaced_by, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey + 10000000, 'active', NULL, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def k7_update_memory(t):
    nodes = t.orders.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("text"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("replaced_by"))
    edges = t.spark.createDataFrame([], "src long, dst long, type string")
    updates = nodes.filter("id % 4 = 0").select("id", (F.col("id") + 10000000).alias("new_id"), F.lit("new").alias("text"))
    return M.update_memory(nodes, edges, updates)[0].select("id", "status", "replaced_by", "text")


@query("SELECT a.conv_id * 1000 + a.turn AS id, a.turn - b.turn AS step, b.conv_id * 1000 + b.turn AS node FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn <= a.turn")
def e10_memory_history(t):
    node = F.col("conv_id") * 1000 + F.col("turn")
    edges = t.conversations.filter("turn > 0").select(node.alias("src"), (node - 1).alias("dst"), F.lit("updates").alias("type"))
    return M.memory_history(edges, t.conversations.select(node.alias("id")))


def _templates(t):
    order = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", order.alias("version"), F.lit("published").alias("status"), F.col("o_orderkey").alias("schema"))


@query("""WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey AS schema FROM orders), a AS (SELECT * FROM v UNION ALL SELECT o_custkey, max(version) + 1, 0 FROM v WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
SELECT o_custkey, version, schema, CASE WHEN version = max(version) OVER (PARTITION BY o_custkey) THEN 'published' ELSE 'archived' END AS status, o_custkey % 5 = 0 AS deleted FROM a""")
def e8_template_versions(t):
    rows = _templates(t)
    changes = rows.select("o_custkey").distinct().filter("o_custkey % 2 = 0").withColumn("schema", F.lit(0).cast(dict(rows.dtypes)["schema"]))
    made = M.publish(M.add_version(rows, changes, "o_custkey", ["schema"]), "o_custkey")
    return M.soft_delete(made, rows.filter("o_custkey % 5 = 0").select("o_custkey").distinct(), "o_custkey").select("o_custkey", "version", "schema", "status", "deleted")


@query("SELECT o_custkey, count(*) AS version, max(o_orderkey) AS schema FROM orders GROUP BY o_custkey")
def e8_current_version(t):
    return M.current_version(_templates(t), "o_custkey").select("o_custkey", F.col("version").cast("long").alias("version"), "schema")


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def h7_flatten_json(t):
    return M.flatten_json(t.events, "event_id", "props").filter("path = 'k'")


@query("SELECT o_orderkey, 'o.key' AS path, o_orderkey::VARCHAR AS value FROM orders UNION ALL SELECT o_orderkey, 'o.tags.' || i, CASE i WHEN 0 THEN o_orderstatus ELSE 'x' END FROM orders, (VALUES (0), (1)) v(i)")
def h7_flatten_nested(t):
    json = F.to_json(F.struct(F.struct(F.col("o_orderkey").alias("key"), F.array("o_orderstatus", F.lit("x")).alias("tags"), F.array().cast("array<string>").alias("none")).alias("o")))
    return M.flatten_json(t.orders.select("o_orderkey", json.alias("j")), "o_orderkey", "j")


@query("SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last, date_sub('second', min(ts), max(ts)) AS seconds FROM events GROUP BY event_type")
def d4_audit_stats(t):
    return P.audit_stats(t.events, "event_type", "ts")


@query("SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars >= 50) AS processed, count(*) FILTER (WHERE n_chars < 50) AS errors FROM documents GROUP BY source")
def d5_processing_summary(t):
    return P.processing_summary(t.documents, "source", F.col("n_chars") >= 50)


@query("SELECT ts::DATE AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def d8_dashboard(t):
    return P.dashboard(t.events, "ts", "user_id", F.col("event_type") == "error")
