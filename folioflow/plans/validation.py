"""Queries over coercion, validation and name mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import coerce as K
from folioflow.functions import text as X
from folioflow.functions import validate as V
from folioflow.operators import mapping as M
from folioflow.operators import reports as P
from folioflow.plans.registry import query


@query("SELECT l_orderkey, l_linenumber, try_cast(regexp_replace('qty ' || l_quantity::VARCHAR || ' -', '[^0-9\\-]', '', 'g') AS BIGINT) AS a, CAST(regexp_replace(format('{:,}', l_partkey::BIGINT), '[^0-9\\-]', '', 'g') AS BIGINT) AS b FROM lineitem".replace("\\\\-", "\\-"))
def h8_coerce_int(t):
    text = F.concat(F.lit("qty "), F.col("l_quantity").cast("string"), F.lit(" -"))
    return t.lineitem.select("l_orderkey", "l_linenumber", K.coerce_int(text).alias("a"), K.coerce_int(F.format_number(F.col("l_partkey"), 0)).alias("b"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS v, CAST(NULL AS DOUBLE) AS bad FROM lineitem")
def h9_coerce_float(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", K.coerce_float(F.concat(F.lit("$ "), F.format_number(F.col("l_extendedprice"), 2))).alias("v"), K.coerce_float(F.lit("1.2.3")).alias("bad"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS v FROM orders")
def h10_coerce_bool(t):
    return t.orders.select("o_orderkey", K.coerce_bool(F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "OFF ").otherwise("?")).alias("v"))


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 2 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END WHEN 7 THEN NULL ELSE d END AS v FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def h11_coerce_date(t):
    d, shown = F.to_date("o_orderdate"), None
    for i, f in enumerate(["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]):
        hit = F.col("o_orderkey") % 8 == i
        shown = F.when(hit, F.date_format(d, f)) if shown is None else shown.when(hit, F.date_format(d, f))
    return t.orders.select("o_orderkey", K.coerce_date(shown.otherwise("no date")).alias("v"))


@query("SELECT p_partkey, p_retailprice::DOUBLE AS amount, CAST(NULL AS DOUBLE) AS none FROM part")
def h12_coerce_currency(t):
    shown = F.concat(F.when(F.col("p_partkey") % 3 == 0, "R ").when(F.col("p_partkey") % 3 == 1, "EUR ").otherwise("ZAR"), F.format_number(F.col("p_retailprice"), 2))
    return t.part.select("p_partkey", K.coerce_currency(shown)["amount"].alias("amount"), K.coerce_currency(F.lit("R x"))["amount"].alias("none"))


@query("""SELECT l_orderkey, l_linenumber, k AS kind, CASE k WHEN 'integer' THEN l_linenumber::VARCHAR WHEN 'date' THEN l_shipdate::DATE::VARCHAR WHEN 'string' THEN l_returnflag END AS coerced, k <> 'boolean' AS success, CASE k WHEN 'boolean' THEN 'cannot coerce to boolean' END AS error
FROM lineitem CROSS JOIN (VALUES ('integer'), ('date'), ('string'), ('boolean')) v(k)""")
def h13_coerce(t):
    ship = F.to_date("l_shipdate").cast("string")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("integer", F.concat(F.lit(" "), F.col("l_linenumber").cast("string"))), ("date", ship), ("string", F.col("l_returnflag")), ("boolean", F.lit("maybe")))])
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.explode(pairs).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "p.kind", K.coerce(F.col("p.value"), F.col("p.kind")).alias("c")).select("l_orderkey", "l_linenumber", "kind", "c.*")


@query("SELECT doc_id, regexp_matches(text, '^(?:[A-Z][a-z]+ )') AS starts, regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+') AS mail FROM documents".replace("\\\\", "\\"))
def h14_regex_valid(t):
    return t.documents.select("doc_id", V.regex_valid(F.col("text"), r"[A-Z][a-z]+ ").alias("starts"), V.regex_valid(F.col("text"), r"[\w.+-]+@[\w-]+\.[\w.]+", search=True).alias("mail"))


_ID = "lpad((c_custkey * 7919 + 8001015009000)::VARCHAR, 13, '0')"


@query(f"""SELECT c_custkey, (SELECT sum(CASE WHEN i % 2 = 0 THEN d WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) FROM (SELECT i, substr({_ID}, i + 1, 1)::INT AS d FROM range(13) r(i))) % 10 = 0 AS valid FROM customer""")
def h15_za_id(t):
    return t.customer.select("c_custkey", V.za_id_valid(F.lpad((F.col("c_custkey") * 7919 + 8001015009000).cast("string"), 13, "0")).alias("valid"))


@query("SELECT c_custkey, ((CAST(lpad(c_custkey::VARCHAR, 14, '0') || '1611' || lpad((10 + c_custkey % 88)::VARCHAR, 2, '0') AS HUGEINT)) % 97 = 1) AS valid FROM customer")
def h16_iban(t):
    iban = F.concat(F.lit("GB"), F.lpad((10 + F.col("c_custkey") % 88).cast("string"), 2, "0"), F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    return t.customer.select("c_custkey", V.iban_valid(iban).alias("valid"))


_RULES = [
    {"field": "c_name", "kind": "required"},
    {"field": "c_mktsegment", "kind": "enum", "values": ["BUILDING", "MACHINERY"]},
    {"field": "c_mktsegment", "kind": "enum_ci", "pattern": "building, furniture"},
    {"field": "c_acctbal", "kind": "min", "min": 0},
    {"field": "c_acctbal", "kind": "max", "max": 9000},
    {"field": "c_name", "kind": "min_length", "min": 18},
    {"field": "c_mktsegment", "kind": "max_length", "max": 8},
    {"field": "c_phone", "kind": "required"},
    {"field": "c_name", "kind": "regex", "pattern": "Customer#0+[1-5]"},
    {"field": "c_name", "kind": "odd"},
]
_VALIDATED = """WITH r AS (SELECT c_custkey, unnest([
 {'field_name': 'c_name', 'rule': 'required', 'ok': trim(c_name) <> '', 'warn': false}, {'field_name': 'c_mktsegment', 'rule': 'enum', 'ok': c_mktsegment IN ('BUILDING', 'MACHINERY'), 'warn': false},
 {'field_name': 'c_mktsegment', 'rule': 'enum_ci', 'ok': lower(c_mktsegment) IN ('building', 'furniture'), 'warn': false}, {'field_name': 'c_acctbal', 'rule': 'min', 'ok': c_acctbal >= 0, 'warn': false},
 {'field_name': 'c_acctbal', 'rule': 'max', 'ok': c_acctbal <= 9000, 'warn': false}, {'field_name': 'c_name', 'rule': 'min_length', 'ok': length(c_name) >= 18, 'warn': false},
 {'field_name': 'c_mktsegment', 'rule': 'max_length', 'ok': length(c_mktsegment) <= 8, 'warn': false}, {'field_name': 'c_phone', 'rule': 'required', 'ok': false, 'warn': false},
 {'field_name': 'c_name', 'rule': 'regex', 'ok': regexp_matches(c_name, '^Customer#0+[1-5]'), 'warn': false}, {'field_name': 'c_name', 'rule': 'odd', 'ok': false, 'warn': true}]) AS x FROM customer),
v AS (SELECT c_custkey, x.field_name AS field_name, x.rule AS rule, CASE WHEN x.warn THEN 'warning' WHEN x.ok THEN 'pass' ELSE 'fail' END AS status FROM r)
"""


@query(_VALIDATED + "SELECT * FROM v")
def c10_validate(t):
    return V.validate(t.customer, _RULES, "c_custkey").select("c_custkey", "field_name", "rule", "status")


@query(_VALIDATED + "SELECT count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status <> 'pass') = 0 AS all_resolved FROM v")
def d3_validation_summary(t):
    return V.validation_summary(V.validate(t.customer, _RULES, "c_custkey"))


@query(_VALIDATED + "SELECT CASE status WHEN 'warning' THEN 'pass' ELSE status END AS status, count(*) AS n FROM v GROUP BY 1")
def d3_accept_warnings(t):
    return V.accept_warnings(V.validate(t.customer, _RULES, "c_custkey")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, 'u' || c_custkey || '@mail.example' AS mail, 'pass' AS mail_status, '+27' || lpad(c_custkey::VARCHAR, 9, '1') AS phone, 'pass' AS phone_status, CASE WHEN c_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END AS date_status, CASE WHEN c_custkey % 2 = 1 THEN 'Date does not match format yyyy-MM-dd' END AS date_error FROM customer""")
def h17_cleaning_rules(t):
    k = F.col("c_custkey").cast("string")
    mail = V.validate_field(F.concat(F.lit("U"), k, F.lit("@Mail.example")), "email")
    phone = V.validate_field(F.concat(F.lit("+27 "), F.lpad(k, 9, "1")), "phone_e164")
    date = V.validate_field(F.when(F.col("c_custkey") % 2 == 0, "2024-02-29").otherwise("2023-02-29"), "date_format")
    return t.customer.select("c_custkey", mail["cleaned"].alias("mail"), mail["status"].alias("mail_status"), phone["cleaned"].alias("phone"), phone["status"].alias("phone_status"), date["status"].alias("date_status"), date["error"].alias("date_error"))


@query("""SELECT c_custkey, CASE WHEN length(c_mktsegment) >= 9 THEN 'pass' ELSE 'fail' END AS least, CASE WHEN length(c_mktsegment) < 9 THEN 'Minimum length 9, got ' || length(c_mktsegment) END AS least_error,
CASE WHEN length(c_mktsegment) <= 8 THEN 'pass' ELSE 'fail' END AS most, CASE WHEN length(c_mktsegment) <= 9 THEN 'pass' ELSE 'fail' END AS shorter FROM customer""")
def h17_length_rules(t):
    least = V.validate_field(F.col("c_mktsegment"), "min_length", min_length=9, min=1)
    most, shorter = V.validate_field(F.col("c_mktsegment"), "max_length", max_length=8), V.validate_field(F.col("c_mktsegment"), "max_length", max=9)
    return t.customer.select("c_custkey", least["status"].alias("least"), least["error"].alias("least_error"), most["status"].alias("most"), shorter["status"].alias("shorter"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN c_custkey % 2 = 1 THEN 'odd key' END AS error FROM customer")
def k8_register_rule(t):
    V.register_rule("even", lambda x: x.try_cast("long") % 2 == 0)
    r = V.validate_field(F.col("c_custkey"), "even", message="odd key")
    return t.customer.select("c_custkey", r["status"].alias("status"), r["error"].alias("error"))


_PARTS = "(SELECT DISTINCT replace(lower(p_type), ' ', '_') AS s FROM part) a CROSS JOIN (SELECT DISTINCT p_brand || '-' || lower(p_type) AS u FROM part) b"
_SIMILAR = """SELECT s, u, CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.85 ELSE least(1.0, (
  coalesce(list_min([i FOR i IN range(1, least(length(x), length(y)) + 1) IF substr(x, i, 1) <> substr(y, i, 1)]) - 1, least(length(x), length(y)))
  + coalesce(list_min([i FOR i IN range(1, least(length(x), length(y)) + 1) IF substr(reverse(x), i, 1) <> substr(reverse(y), i, 1)]) - 1, least(length(x), length(y)))) / greatest(length(x), length(y), 1)) END AS score
FROM (SELECT s, u, replace(replace(lower(s), '_', ''), '-', '') AS x, replace(replace(lower(u), '_', ''), '-', '') AS y FROM """ + _PARTS + ")"


@query("SELECT s, u, round(score, 6) AS score FROM (" + _SIMILAR + ")")
def h18_name_similarity(t):
    a = t.part.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("s")).distinct()
    b = t.part.select(F.concat("p_brand", F.lit("-"), F.lower("p_type")).alias("u")).distinct()
    return M.name_pairs(a, b, "s", "u").select("s", "u", F.round("score", 6).alias("score"))


@query("SELECT s, u, round(score, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, u) AS i FROM (" + _SIMILAR + ") WHERE score >= 0.7) WHERE i = 1")
def c5_fuzzy_map(t):
    a = t.part.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("s")).distinct()
    b = t.part.select(F.concat("p_brand", F.lit("-"), F.lower("p_type")).alias("u")).distinct()
    return M.fuzzy_map(a, b, "s", "u").select("s", "u", F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey, replace(replace(lower(p_brand || '_' || p_type), '_', ''), '-', '') AS name FROM part")
def h19_normalize_name(t):
    return t.part.select("p_partkey", X.normalize_name(F.concat_ws("_", "p_brand", "p_type")).alias("name"))


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(p_brand || ' / ' || p_type, '[\\s/\\-]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) AS name FROM part".replace("\\\\", "\\"))
def h20_snake_case(t):
    return t.part.select("p_partkey", X.to_snake_case(F.concat_ws(" / ", "p_brand", "p_type")).alias("name"))


@query("SELECT p_partkey, trim(regexp_replace(lower('#' || p_brand || ' & ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def h21_slug(t):
    return t.part.select("p_partkey", X.slug(F.concat(F.lit("#"), "p_brand", F.lit(" & "), "p_name")).alias("slug"))


@query("""SELECT DISTINCT name, CASE WHEN regexp_matches(name, 'date|time|day') THEN 'date' WHEN regexp_matches(name, 'hours|amount|number|count|quantity') THEN 'numeric' ELSE 'string' END AS data_type,
CASE WHEN regexp_matches(name, 'date|time|day') THEN 'YYYY-MM-DD' WHEN regexp_matches(name, 'hours|amount|number|count|quantity') THEN 'decimal(10,2)' WHEN regexp_matches(name, 'code|id') THEN 'varchar(20)' ELSE 'varchar(255)' END AS length_format
FROM (SELECT lower(p_brand) || CASE p_size % 4 WHEN 0 THEN '_date' WHEN 1 THEN '_amount' WHEN 2 THEN '_id' ELSE '_x' END AS name FROM part)""")
def h25_infer_from_name(t):
    name = F.concat(F.lower("p_brand"), F.when(F.col("p_size") % 4 == 0, "_date").when(F.col("p_size") % 4 == 1, "_amount").when(F.col("p_size") % 4 == 2, "_id").otherwise("_x"))
    got = X.infer_from_name(F.col("name"))
    return t.part.select(name.alias("name")).distinct().select("name", got["data_type"].alias("data_type"), got["length_format"].alias("length_format"))


_MAPPED = """WITH s AS (SELECT DISTINCT 's_' || lower(p_brand) AS f FROM part), u AS (SELECT DISTINCT lower(p_brand) AS f FROM part WHERE p_size > 2)"""


@query(_MAPPED + " SELECT s.f AS source FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE s.f = 's_' || u.f AND u.f < 'brand#3')")
def g5_unmapped(t):
    s = t.part.select(F.concat(F.lit("s_"), F.lower("p_brand")).alias("source")).distinct()
    pairs = t.part.filter("p_size > 2 and lower(p_brand) < 'brand#3'").select(F.concat(F.lit("s_"), F.lower("p_brand")).alias("source"), F.lower("p_brand").alias("target")).distinct()
    return M.unmapped(s, pairs, "source")


@query("SELECT r_name AS source, CASE WHEN r_regionkey = 0 THEN 'first' ELSE lower(r_name) END AS target, 1.0 AS confidence FROM region WHERE r_regionkey < 4")
def g7_map_fields(t):
    source = t.region.select(F.col("r_name").alias("source"))
    target = t.region.filter("r_regionkey < 4").select(F.when(F.col("r_regionkey") == 0, "first").otherwise(F.lower("r_name")).alias("target"))
    manual = t.region.filter("r_regionkey = 0 or r_regionkey = 4").select(F.col("r_name").alias("source"), F.when(F.col("r_regionkey") == 0, "first").otherwise("nowhere").alias("target"))
    return M.map_fields(source, target, manual, threshold=0.95)


@query("SELECT count(*) AS mapped, coalesce(round(avg(score), 6), 0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, u) AS i FROM (" + _SIMILAR + ") WHERE score >= 0.7) WHERE i = 1")
def d7_mapping_summary(t):
    a = t.part.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("s")).distinct()
    b = t.part.select(F.concat("p_brand", F.lit("-"), F.lower("p_type")).alias("u")).distinct()
    return M.mapping_summary(M.fuzzy_map(a, b, "s", "u"))


@query("SELECT substr(sha256(k), 1, 16) AS hash, count(*) AS n FROM (SELECT CASE WHEN props LIKE '%\"k\"%' THEN 'event_type:' || event_type || ',k:bigint' ELSE 'event_type:' || event_type END AS k FROM events) GROUP BY 1")
def h6_structure_hash(t):
    from folioflow.functions.hashing import structure_hash

    types = F.map_concat(F.create_map(F.lit("event_type"), F.col("event_type")), F.when(F.col("props").contains('"k"'), F.create_map(F.lit("k"), F.lit("bigint"))).otherwise(F.create_map().cast("map<string,string>")))
    return t.events.select(structure_hash(types).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


@query("SELECT 'event_type' AS field, 'string' AS type UNION ALL SELECT 'k', 'integer' UNION ALL SELECT 'when', 'date' UNION ALL SELECT 'ok', 'boolean' UNION ALL SELECT 'v', 'float'")
def h26_infer_types(t):
    rows = t.events.select("event_id", F.to_json(F.struct("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_date("ts").alias("when"), (F.col("user_id") > 0).alias("ok"), (F.col("value").cast("double") + 0.5).alias("v"))).alias("j"))
    return M.infer_types(rows, "j", ["event_id"])


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'number (sample: ' || doc_id || ')' WHEN 1 THEN 'boolean (sample: ' || (n_chars > 500) || ')' WHEN 2 THEN 'array (length: 2)' WHEN 3 THEN 'object (keys: a, b, c)'
 ELSE 'string (sample: ' || substr(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END || ')' END AS shown FROM documents WHERE text IS NOT NULL""")
def h38_sample_context(t):
    quoted = F.to_json(F.struct(F.col("text").alias("x"), F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("doc_id").alias("c"), F.array("doc_id", "n_chars").alias("l"), (F.col("n_chars") > 500).alias("o")))
    whole = F.parse_json(F.when(F.col("doc_id") % 5 == 3, F.to_json(F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit(1).alias("c"), F.lit(1).alias("d")))).otherwise(quoted))
    value = F.when(F.col("doc_id") % 5 == 3, whole)
    for i, name in enumerate(("a", "o", "l", None, "x")):
        if name:
            value = F.when(F.col("doc_id") % 5 == i, F.variant_get(whole, f"$.{name}", "variant")).otherwise(value)
    return t.documents.filter("text is not null").select("doc_id", M.sample_context(value).alias("shown"))


@query("SELECT CASE WHEN props LIKE '%\"k\"%' THEN 'k' ELSE '' END AS keys, count(*) AS usage_count, count(DISTINCT user_id) AS n_paths, max(ts) AS last_used FROM events GROUP BY 1")
def d13_structure_registry(t):
    files = t.events.select(F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.col("user_id").cast("string").alias("path"), "ts")
    return M.structure_registry(files, "keys", "path", "ts").select("keys", "usage_count", "n_paths", "last_used")


@query("SELECT user_id, event_type AS kind, max(event_id) AS latest FROM events GROUP BY ALL")
def c14_find_structure(t):
    keys = t.events.select("user_id", F.col("event_type").alias("kind")).distinct()
    cache = t.events.select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("latest"))
    return M.find_structure(cache, keys, ["user_id", "kind"], "latest")


@query("SELECT user_id, n, last FROM (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) ORDER BY n DESC, last DESC, user_id LIMIT 20")
def f2_top_structures(t):
    return P.top_structures(t.events, "user_id", "ts", 20)
