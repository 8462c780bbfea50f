"""Queries over records: projections, filters, edits, merges and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import hashing
from folioflow.operators import records as R
from folioflow.operators import reports as P
from folioflow.plans.registry import query
from folioflow.sources.shared import shared_folder


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def b1_transform(t):
    return R.transform(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' END AS level, o_orderstatus FROM orders")
def b2_add_column(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.add_column(rows, "level", "high", "after", "o_orderkey", F.col("o_totalprice") > 100000).drop("o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice, 2 AS removed FROM orders")
def b3_remove_columns(t):
    rows, n = R.remove_columns(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate"), ["o_orderstatus", "o_orderdate", "none"])
    return rows.withColumn("removed", F.lit(n))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_quantity AS DOUBLE) >= 45 AND lower(l_returnflag) = 'r'")
def b4_condition(t):
    return t.lineitem.filter(R.condition(t.lineitem, "l_quantity", "greater_equal", 45) & R.condition(t.lineitem, "l_returnflag", "equals", "r")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (lower(l_returnflag) = 'r' OR CAST(l_discount AS DOUBLE) > 0.08) AND lower(l_linestatus) <> 'o'")
def b5_compound(t):
    c = lambda *a: R.condition(t.lineitem, *a)
    return t.lineitem.filter(R.all_of(R.any_of(c("l_returnflag", "equals", "R"), c("l_discount", "greater_than", 0.08)), c("l_linestatus", "not_equals", "O"))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (lower(o_orderstatus) = 'f')")
def b6_remove_rows(t):
    return R.remove_rows(t.orders, R.condition(t.orders, "o_orderstatus", "equals", "F")).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, props FROM events WHERE coalesce(props, '') <> ''")
def b7_remove_empty(t):
    return R.remove_empty(t.events.select("event_id", "props"), "props")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i NOT IN (0, 3, 7)")
def b8_remove_positions(t):
    return R.remove_positions(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], [0, 3, 7])


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE contains(trim(lower(c_mktsegment)), 'build') AND CAST(c_acctbal AS DOUBLE) > 1000")
def b9_query_filter(t):
    return t.customer.filter(R.condition(t.customer, "c_mktsegment", "contains", " Build ", trimmed=True) & R.condition(t.customer, "c_acctbal", "greater_than", 1000)).select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i IN (1, 4, 24)")
def b10_take_positions(t):
    return R.take_positions(t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], [1, 4, 24])


@query("SELECT c_custkey::VARCHAR AS c_custkey, coalesce(c_name, '') AS c_name, '' AS phone FROM customer")
def b14_complete_to_schema(t):
    return R.complete_to_schema(t.customer, ["c_custkey", "c_name", "phone"])


@query("SELECT r_regionkey::VARCHAR AS id, r_name AS name, CAST(NULL AS VARCHAR) AS more FROM region")
def b15_cells_to_columns(t):
    return R.cells_to_columns(t.region.select(F.array(F.col("r_regionkey").cast("string"), "r_name").alias("cells")), "cells", ["id", "name", "more"])


def _altered(t):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    return rows, rows.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).union(rows.filter("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


_ALTERED = """WITH o AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer),
n AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM o WHERE c_custkey % 11 <> 0
      UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM o WHERE c_custkey % 13 = 0)"""


@query(_ALTERED + """, s AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_custkey AS ok, n.c_custkey AS nk, f.field, CASE f.field WHEN 'c_acctbal' THEN o.c_acctbal IS NOT DISTINCT FROM n.c_acctbal ELSE true END AS same
 FROM o FULL JOIN n ON o.c_custkey = n.c_custkey CROSS JOIN (VALUES ('c_name'), ('c_nationkey'), ('c_acctbal')) f(field))
SELECT c_custkey, field, CASE WHEN ok IS NULL THEN 'added' WHEN nk IS NULL THEN 'removed' WHEN same THEN 'unchanged' ELSE 'changed' END AS status FROM s""")
def c2_diff_records(t):
    return R.diff_records(*_altered(t), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def c3_merge_subset(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return R.merge_subset(rows, rows.filter("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X")), "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'invalid' WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'X' THEN 'modified' ELSE 'unchanged' END AS status FROM orders""")
def c4_verify_changes(t):
    protected = hashing.protect(t.orders.select("o_orderkey", "o_orderstatus"))
    edits = protected.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "_hash": F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("_hash"))})
    return R.verify_changes(protected, edits).select("o_orderkey", "status")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT turn + 1000000000 FROM conversations WHERE conv_id % 10 <> 0")
def c11_cascade_delete(t):
    gone = t.documents.filter("doc_id % 10 = 0").select("doc_id")
    docs, turns = R.cascade_delete(t.documents.select("doc_id"), t.conversations.select("conv_id", "turn"), "doc_id", "conv_id", gone.union(t.conversations.filter("conv_id % 10 = 0").select("conv_id")).distinct())
    return docs.union(turns.select(F.col("turn").cast("long") + 1000000000))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def c12_insert_missing(t):
    rows = t.supplier.select("s_suppkey", "s_name")
    return R.insert_missing(rows.filter("s_suppkey % 3 <> 0"), rows, "s_name")


@query("SELECT o_orderkey, o_custkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def c13_parent_child(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return P.parent_child(t.orders.select("o_orderkey", "o_custkey"), lines, "o_orderkey", "l_orderkey", ["o_orderkey", "l_linenumber"]).drop("l_orderkey")


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, -2 FROM embeddings WHERE vec_id % 50 = 0")
def a13_upsert(t):
    rows = t.embeddings.select("vec_id", "label")
    updates = rows.filter("vec_id % 4 = 0").withColumn("label", F.lit(-1)).union(rows.filter("vec_id % 50 = 0").select(F.col("vec_id") + 1000000, F.lit(-2)))
    return R.upsert(rows, updates, ["vec_id"])


@query("SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, -2 FROM embeddings WHERE vec_id % 50 = 0")
def a13_upsert_kept(t):
    path = shared_folder(t.spark, "kept")
    rows = t.embeddings.select("vec_id", "label")
    R.upsert_kept(t.spark, path, rows, ["vec_id"], 16)
    R.upsert_kept(t.spark, path, rows.filter("vec_id % 4 = 0").withColumn("label", F.lit(-1)), ["vec_id"])
    R.upsert_kept(t.spark, path, rows.filter("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(-2).alias("label")), ["vec_id"])
    return t.spark.read.parquet(path).select("vec_id", "label")


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 6 <> 0 AND label >= 3 GROUP BY label")
def a14_delete_get_count(t):
    left = R.delete_ids(t.embeddings, t.embeddings.filter("vec_id % 6 = 0"), "vec_id")
    return R.count_where(left, F.col("label") >= 3, "label")


@query("SELECT DISTINCT text FROM documents")
def g3_dedupe_rows(t):
    return R.dedupe_rows(t.documents.select("text"))


@query("""SELECT c_custkey, seg, nation FROM (SELECT c_custkey, c_mktsegment AS seg, c_nationkey::VARCHAR AS nation, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS i FROM customer) WHERE i = 1""")
def g4_dedupe_signature(t):
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").cast("string").alias("nation"))
    return R.dedupe_signature(rows, ["seg", "nation"], ["c_custkey"])


@query("SELECT p_brand, arg_min(p_partkey, struct_pack(a := -length(p_name), b := p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def e5_keep_richest(t):
    return R.keep_richest(t.part.select("p_brand", "p_partkey", "p_name"), "p_brand", "p_name", ["p_partkey"]).select("p_brand", "p_partkey")


@query("SELECT p_type, CASE WHEN p_type LIKE '%A%' THEN 'new' ELSE 'old' END AS version FROM (SELECT DISTINCT p_type FROM part)")
def g6_merge_fields(t):
    kinds = t.part.select("p_type").distinct()
    return R.upsert(kinds.withColumn("version", F.lit("old")), kinds.filter("p_type like '%A%'").withColumn("version", F.lit("new")), ["p_type"])


@query("SELECT l_suppkey, (i - 1) // 20 AS batch, count(*) AS expected, min(l_orderkey) AS first, max(l_orderkey) AS last FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem) GROUP BY ALL")
def e9_batch_rows(t):
    return R.batch_rows(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 20)


@query("SELECT o_custkey, count(*) AS n, CASE WHEN count(*) <= 30 THEN 1 WHEN count(*) <= 60 THEN 2 WHEN count(*) <= 120 THEN 3 WHEN count(*) <= 240 THEN 5 WHEN count(*) <= 500 THEN 8 ELSE 10 END AS size FROM orders GROUP BY o_custkey")
def i7_adaptive_size(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("size", R.adaptive_size(F.col("n")))


@query("SELECT region, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT n_regionkey AS region, n_nationkey AS i, concat_ws(' | ', n_nationkey, n_name) AS line FROM nation UNION ALL SELECT r_regionkey, -1, 'n_nationkey | n_name' FROM region) GROUP BY region")
def a9_rows_to_text(t):
    from folioflow.sources.sinks import rows_to_text

    return rows_to_text(t.nation, ["n_regionkey"], ["n_nationkey", "n_name"], ["n_nationkey"]).select(F.col("n_regionkey").alias("region"), "text")


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 40 AND p_name ILIKE '%re%'")
def b11_list_live(t):
    rows = t.part.withColumn("deleted_at", F.when(F.col("p_size") >= 40, F.lit("gone")))
    return P.list_live(rows, "deleted_at", "p_name", contains="Re", order=[F.desc("p_partkey")]).select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def b16_list_jobs(t):
    return P.newest(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("o_orderstatus") == "O", "o_orderdate", "o_orderkey", 50).drop("o_orderstatus")
