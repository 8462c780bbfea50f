"""Queries over model jobs, with stub functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.replies import reply_records
from folioflow.operators import models as J
from folioflow.plans.registry import query


def _upper():
    return lambda prompts: [p.upper() for p in prompts]


def _picky():
    def call(prompts):
        if any("1" in p for p in prompts):
            raise ValueError("a 1 in it")
        return ["s:" + p for p in prompts]

    return call


def _echo():
    return lambda prompts: ["l:" + p for p in prompts]


@query("SELECT o_orderkey, upper(o_orderpriority) AS reply, CAST(NULL AS VARCHAR) AS error FROM (SELECT o_orderkey, lower(o_orderstatus) || 'x' AS o_orderpriority FROM orders)")
def k1_model_map(t):
    rows = t.orders.select("o_orderkey", F.concat(F.lower("o_orderstatus"), F.lit("x")).alias("prompt"))
    return J.model_map(rows, "prompt", _upper).select("o_orderkey", "reply", "error")


@query("SELECT o_orderkey, error FROM (SELECT o_orderkey, CASE WHEN contains(o_orderkey::VARCHAR, '1') THEN 'a 1 in it' END AS error FROM orders)")
def k1_model_errors(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("prompt"))
    return J.model_map(rows, "prompt", _picky, batch=1, retries=0).select("o_orderkey", "error")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN 'l:' || substr('key ' || l_orderkey || ' text', 1, 7) WHEN contains(l_orderkey::VARCHAR, '1') THEN 'l:key ' || l_orderkey || ' text' ELSE 's:key ' || l_orderkey || ' text' END AS reply, CASE WHEN l_linenumber >= 3 OR contains(l_orderkey::VARCHAR, '1') THEN 'large' ELSE 'small' END AS tier FROM lineitem")
def k2_tiered_map(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("key "), F.col("l_orderkey").cast("string"), F.lit(" text")).alias("prompt"))
    return J.tiered_map(rows, "prompt", "l_linenumber", _picky, _echo, first=3, cut=7, retries=0).select("l_orderkey", "l_linenumber", "reply", "tier")


def _replies(t):
    row = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))
    kind = F.col("o_orderkey") % 7
    shaped = (
        F.when(kind == 0, F.concat(F.lit("["), row, F.lit(","), row, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("Here:\n```json\n["), row, F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit('{"rows": ['), row, F.lit("]}")))
        .when(kind == 3, F.concat(F.lit('{"data": ['), row, F.lit(","), row, F.lit("]}")))
        .when(kind == 4, row)
        .when(kind == 5, F.concat(F.lit("[ "), row, F.lit(", {broken, "), row))
        .otherwise("nothing here")
    )
    return t.orders.select("o_orderkey", "o_orderstatus", shaped.alias("reply"))


@query("""SELECT o_orderkey, i, o_orderkey::VARCHAR AS k, CAST(NULL AS VARCHAR) AS error FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 7 < 6 AND (i = 0 OR o_orderkey % 7 IN (0, 3, 5))
UNION ALL SELECT o_orderkey, NULL, NULL, 'no records: nothing here' FROM orders WHERE o_orderkey % 7 = 6""")
def h30_parse_json_reply(t):
    got = reply_records(_replies(t), "o_orderkey", "reply")
    return got.select("o_orderkey", "i", F.get_json_object("record", "$.k").alias("k"), "error")


@query("SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS s, '' AS missing FROM orders WHERE o_orderkey % 7 < 6")
def k3_extract_records(t):
    def same():
        return lambda prompts: prompts

    rows = _replies(t).withColumnRenamed("reply", "prompt")
    return J.extract_records(rows, "o_orderkey", "prompt", ["k", "s", "missing"], same)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def k4_guarded_update(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    edit = lambda p: p.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return J.guarded_update(rows, "o_orderkey", F.col("o_orderkey") % 3 == 0, edit)[0]


@query("SELECT conv_id * 100 + turn AS id0, CASE WHEN turn % 2 = 0 THEN 'f' || substr(text, 1, 3) ELSE text END AS fact, CASE WHEN turn % 2 = 0 THEN 0.9 ELSE 0.8 END AS confidence, 0.5 AS importance FROM conversations WHERE length(text) > 50")
def k5_extract_memories(t):
    def facts():
        import json

        return lambda prompts: [json.dumps([{"fact": "f" + p.split("|", 1)[1][:3], "confidence": 0.9}]) if int(p.split("|", 1)[0]) % 2 == 0 else "none" for p in prompts]

    rows = t.conversations.filter(F.length("text") > 50).select((F.col("conv_id") * 100 + F.col("turn")).alias("id0"), F.concat_ws("|", F.col("turn").cast("string"), "text").alias("text"))
    got = J.extract_memories(rows, "id0", "text", facts)
    return got.select("id0", F.regexp_replace("fact", r"^\d+\|", "").alias("fact"), "confidence", "importance")
