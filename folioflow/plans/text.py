"""Queries over texts, chunks, pages and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import hashing as H
from folioflow.functions import text as X
from folioflow.operators import chunks as C
from folioflow.operators import reports as P
from folioflow.plans.registry import query
from folioflow.sources.sinks import render_pages, with_envelope

_STOP = ", ".join(f"'{w}'" for w in X.SIMPLE_STOP_WORDS)


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def h1_sha256(t):
    return t.documents.select("doc_id", H.sha256(F.col("text")).alias("h"))


@query("SELECT n_nationkey, 'n_name' AS field, sha256(n_name) AS h FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', sha256(n_regionkey::VARCHAR) FROM nation")
def h2_hash_fields(t):
    return t.nation.select("n_nationkey", F.explode(H.hash_fields(t.nation, ["n_name", "n_regionkey"])).alias("field", "h"))


@query("SELECT r_regionkey, sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}') AS _hash FROM region")
def h4_record_hash(t):
    return H.protect(t.region.select("r_regionkey", "r_name")).select("r_regionkey", "_hash")


_PADS = [bytes(k ^ b for k in b"key".ljust(64, b"\0")).hex() for b in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(text)))) AS signature, true AS verified, false AS forged FROM documents")
def h5_hmac(t):
    sign = H.hmac_sign(F.col("text"), b"key")
    return t.documents.select("doc_id", sign.alias("signature"), H.hmac_verify(F.col("text"), b"key", sign).alias("verified"), H.hmac_verify(F.concat("text", F.lit("x")), b"key", sign).alias("forged"))


@query("SELECT doc_id, CASE WHEN length(text) < 50 THEN 0.2 WHEN length(text) > 5000 THEN 0.5 ELSE 0.9 END AS quality FROM documents")
def h22_quality_score(t):
    return t.documents.select("doc_id", X.quality_score(F.col("text")).alias("quality"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('Page 1 of 3 ' || replace(text, chr(10), chr(10) || chr(10) || chr(10)), 'page\s+\d+\s+of\s+\d+', '', 'gi'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[^\x00-\x7F]+', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def h23_clean_text(t):
    return t.documents.select("doc_id", X.clean_text(F.concat(F.lit("Page 1 of 3 "), F.replace("text", F.lit("\n"), F.lit("\n\n\n")))).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, 'th', 'ht'), 'tion', 'cion'), '[|~^]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '[\s_.\-]+$', '') AS text FROM documents""")
def h24_corrections(t):
    return t.documents.select("doc_id", X.apply_corrections(F.col("text"), [("th", "ht"), ("tion", "cion")]).alias("text"))


def _headers(words):
    return " OR ".join(f"contains(lower(s), '{w}')" for w in words)


@query(rf"""SELECT doc_id, unnest(list_slice(list_distinct_in_order, 1, 64)) AS candidate FROM (
  SELECT doc_id, list(c ORDER BY i) AS list_distinct_in_order FROM (
    SELECT doc_id, c, min(i) AS i FROM (
      SELECT doc_id, i, CASE WHEN s <> '' AND length(s) < 100 AND ({_headers(X.HEADER_WORDS["txt"])}) THEN s WHEN s <> '' AND length(s) < 100 AND len(string_split(s, ':')) = 2 AND trim(split_part(s, ':', 1)) <> '' AND length(trim(split_part(s, ':', 1))) < 50 THEN trim(split_part(s, ':', 1)) END AS c
      FROM (SELECT doc_id, i, trim(x) AS s FROM (SELECT doc_id, unnest(l[1:50]) AS x, generate_subscripts(l[1:50], 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))
    WHERE c IS NOT NULL GROUP BY doc_id, c) GROUP BY doc_id)""")
def h27_header_candidates(t):
    return t.documents.select("doc_id", F.explode(X.header_candidates(F.col("text"))).alias("candidate"))


def _employees(t):
    block = F.format_string("Employee ID: %d\nName: %s\nNote %d\nDepartment: %s\n", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return t.customer.select("c_custkey", block.alias("text"))


@query("SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS dept, CAST(NULL AS VARCHAR) AS hours FROM customer")
def h28_parse_kv(t):
    m = X.parse_kv(F.col("text"), ["id", "name", "department", "hours"])
    return _employees(t).select("c_custkey", m.alias("m")).select("c_custkey", F.col("m.id").alias("id"), F.col("m.name").alias("name"), F.col("m.department").alias("dept"), F.col("m.hours").alias("hours"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS dept, 'N/A' AS hours FROM customer")
def h29_extract_fields(t):
    x = F.col("text")
    return _employees(t).select("c_custkey", X.extract_field(x, "name").alias("name"), X.extract_field(x, "department").alias("dept"), X.extract_field(x, "hours").alias("hours"))


@query(rf"""SELECT doc_id, array_to_string(list_slice(ws, 1, 20), ' ') AS keywords FROM (
 SELECT doc_id, list(w ORDER BY i) AS ws FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+') AS l FROM documents))
 WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY doc_id, w) GROUP BY doc_id)""")
def h31_keywords_simple(t):
    return t.documents.select("doc_id", F.array_join(X.keywords_simple(F.col("text")), " ").alias("keywords")).filter("keywords <> ''")


@query(rf"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+'), lambda w: strlen(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in X.INDEX_STOP_WORDS)}))) AS n FROM documents""")
def h32_keyword_tokens(t):
    return t.documents.select("doc_id", F.size(X.keyword_tokens(F.col("text"))).cast("long").alias("n"))


@query("SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'add_column' WHEN 1 THEN 'remove_column' WHEN 2 THEN 'remove_rows' ELSE 'update_values' END AS class FROM conversations")
def h33_classify_command(t):
    lead = F.when(F.col("conv_id") % 4 == 0, "Please ADD a column x. ").when(F.col("conv_id") % 4 == 1, "drop field y. ").when(F.col("conv_id") % 4 == 2, "Delete where z is 1. ").otherwise("set z. ")
    return t.conversations.select("conv_id", "turn", X.classify_command(F.concat(lead, "text")).alias("class"))


_TYPES = {"english": ["the", "and", "tion"], "french": [" le ", "eau", "ment"], "german": ["ung", "keit", "sch"], "spanish": ["ción", " de ", "que"]}
_HITS = {k: " + ".join(f"contains(lower(text), '{w}')::INT" for w in v) for k, v in _TYPES.items()}


@query(f"SELECT doc_id, CASE WHEN m = 0 THEN NULL {' '.join(f'WHEN {k} = m THEN ' + repr(k) for k in _TYPES)} END AS kind FROM (SELECT *, greatest({', '.join(_TYPES)}) AS m FROM (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM documents))")
def h34_detect_type(t):
    return t.documents.select("doc_id", X.detect_type(F.col("text"), _TYPES).alias("kind"))


@query("SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'edition')::INT + contains(lower(text), 'ner')::INT AS score FROM documents")
def h35_keyword_score(t):
    return t.documents.select("doc_id", X.keyword_score(F.col("text"), ["the_edition", "ner", "x"]).alias("score"))


@query("SELECT p_partkey, f AS field FROM (SELECT p_partkey, unnest(['Part Name', 'Size', 'Total', 'col ' || p_size]) AS f FROM part)")
def h36_form_fields(t):
    form = F.concat(F.lit("Part Name: ____\n12 Size ____\n* Total : 5\n| col "), F.col("p_size").cast("string"), F.lit(" | other |"))
    return t.part.select("p_partkey", F.explode(X.extract_form_fields(form)).alias("field"))


@query("SELECT p_partkey, 'size' AS name, 'int' AS data_type, 'n' AS length_format, p_brand || ' allowed: a, b more text' AS special, CAST(NULL AS BOOLEAN) AS required, 'a/b' AS allowed FROM part UNION ALL SELECT p_partkey, 'mode', 'text', '9', 'required', true, '' FROM part")
def h37_field_defs(t):
    text = F.concat(F.lit("INTRO\nField Name\tData Type\tLength / Format\tSpecial\nsize\tint\tn\t"), "p_brand", F.lit(" allowed: a, b\nmore text\n\nmode\ttext\t9\trequired\nTHE END\nx\ty\tz\tw"))
    got = C.parse_field_defs(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text")
    return got.withColumn("allowed", F.array_join("allowed", "/"))


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def h41_count_tokens(t):
    return t.documents.select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


@query("SELECT o_custkey, least(8192, greatest(3000, floor((count(*) * 9 * 15 + 300) * 1.3)))::BIGINT AS budget, 9 * 100 * count(*) / 4 > 7000 OR count(*) > 20 AS chunked FROM orders GROUP BY o_custkey")
def h42_token_budget(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", X.token_budget(F.col("n"), F.lit(9)).alias("budget"), X.needs_chunking(F.col("n"), F.lit(9)).alias("chunked"))


@query("SELECT p_brand, string_agg('Field: ' || p_name || ' | Type: ' || p_type || ' | Notes: ' || p_size, chr(10) ORDER BY p_partkey) AS card FROM part GROUP BY p_brand")
def h43_template_card(t):
    return P.template_card(t.part, "p_brand", "p_partkey", F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def h44_render_prompt(t):
    return P.render_prompt(t.conversations, "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'eau') THEN 'eau' WHEN contains(lower(text), 'ung') THEN 'Ung' WHEN contains(lower(text), 'the') THEN 'the' ELSE 'eau' END AS label FROM conversations")
def h45_pick_label(t):
    return t.conversations.select("conv_id", "turn", X.pick_label(F.col("text"), ["eau", "Ung", "the"]).alias("label"))


@query("SELECT event_id, least(1.0, greatest(0.0, value / 50 - 0.2)) AS importance FROM events")
def h46_clamp(t):
    return t.events.select("event_id", X.clamp01(F.col("value") / 50 - 0.2).alias("importance"))


def _spaced(t):
    return t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))


@query(r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk, p AS text FROM (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n') AS l FROM documents))) WHERE p <> ''")
def i1_paragraphs(t):
    return C.split_paragraphs(_spaced(t), "doc_id", F.col("text"))


_PARAGRAPHS = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, string_split_regex(p, '\s+') AS ws FROM (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS p FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n') AS l FROM documents))) WHERE p <> ''"""
_WORD_CHUNKS = f"""WITH RECURSIVE p AS ({_PARAGRAPHS}),
e AS (SELECT doc_id, k, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS past FROM p),
a AS (SELECT doc_id, flatten(list(ws ORDER BY k)) AS ws FROM p GROUP BY doc_id),
r AS (SELECT doc_id, k, 0::BIGINT AS first, past, 0::BIGINT AS chunk FROM e WHERE k = 1
 UNION ALL SELECT e.doc_id, e.k, CASE WHEN r.past > r.first AND e.past - r.first > 512 THEN greatest(r.first, r.past - 50) ELSE r.first END, e.past, CASE WHEN r.past > r.first AND e.past - r.first > 512 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN e ON e.doc_id = r.doc_id AND e.k = r.k + 1),
c AS (SELECT doc_id, chunk, array_to_string(ws[min(first) + 1:max(past)], ' ') AS text FROM r JOIN a USING (doc_id) GROUP BY doc_id, chunk, ws)
"""


@query(_WORD_CHUNKS + "SELECT doc_id, chunk, text FROM c")
def i2_word_chunks(t):
    return C.word_chunks(_spaced(t), "doc_id", "text")


_WINDOW_END = r"CASE WHEN start + 512 >= n THEN n ELSE start + CASE WHEN length(m) >= 2 THEN length(m) ELSE 512 END END"
_WINDOW_SPACE = r"regexp_extract(substr(text, start + 1, 512), '(?s)^.*[ \n\t]')"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text)::BIGINT AS n, 0::BIGINT AS chunk, 0::BIGINT AS start FROM documents WHERE text <> ''),
r AS (SELECT doc_id, text, n, chunk, start, {_WINDOW_END} AS past FROM (SELECT *, {_WINDOW_SPACE} AS m FROM d)
 UNION ALL SELECT doc_id, text, n, chunk, start, {_WINDOW_END} FROM (SELECT *, {_WINDOW_SPACE} AS m FROM (SELECT doc_id, text, n, chunk + 1 AS chunk, greatest(past - 64, start + 1) AS start FROM r WHERE past < n)))
SELECT doc_id, chunk, substr(text, start + 1, past - start) AS text FROM r""")
def i3_char_chunks(t):
    return C.char_chunks(t.documents, "doc_id", "text")


_PACKED = """WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, length(text) AS n FROM documents WHERE text <> ''),
r AS (SELECT doc_id, ls, 1 AS i, 0::BIGINT AS chunk, length(ls[1])::BIGINT + 1 AS size, n FROM l
 UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN n > {size} AND size + length(ls[i + 1]) + 1 > {size} THEN chunk + 1 ELSE chunk END, CASE WHEN n > {size} AND size + length(ls[i + 1]) + 1 > {size} THEN length(ls[i + 1]) + 1 ELSE size + length(ls[i + 1]) + 1 END, n FROM r WHERE i < len(ls))
SELECT doc_id, chunk, string_agg(ls[i], chr(10) ORDER BY i) AS text FROM r GROUP BY doc_id, chunk"""


@query(_PACKED.format(size=3000))
def i4_line_chunks(t):
    return C.line_chunks(t.documents, "doc_id", "text", 3000)


@query("""WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
s AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS past FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l WHERE length(text) > 2500)),
r AS (SELECT doc_id, 1::BIGINT AS i, 1::BIGINT AS first, 0::BIGINT AS chunk FROM s WHERE i = 1
 UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.past - coalesce(b.past, 0) > 2500 THEN greatest(r.first, r.i - 1) ELSE r.first END, CASE WHEN s.past - coalesce(b.past, 0) > 2500 THEN r.chunk + 1 ELSE r.chunk END
 FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1 LEFT JOIN s b ON b.doc_id = r.doc_id AND b.i = r.first - 1)
SELECT doc_id, chunk, array_to_string(ls[min(first):max(i)], chr(10)) AS text FROM r JOIN l USING (doc_id) GROUP BY doc_id, chunk, ls
UNION ALL SELECT doc_id, 0, text FROM l WHERE length(text) <= 2500""")
def i5_line_chunks_carry(t):
    return C.line_chunks(t.documents, "doc_id", "text", 2500, carry=2)


_PAGED = "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations"


@query(f"SELECT conv_id, i // 2 AS chunk, string_agg(text, chr(10) || chr(10) || '---PAGE BREAK---' || chr(10) || chr(10) ORDER BY i) AS text FROM ({_PAGED}) GROUP BY conv_id, i // 2")
def i6_page_chunks(t):
    pages = F.array_sort(F.collect_list(F.struct("turn", "text")))
    docs = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\nPage 7\n").alias("text"))
    return C.page_chunks(docs, "conv_id", F.col("text"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role || ': ' || text AS s FROM conversations),
r AS (SELECT conv_id, i, s, 0::BIGINT AS chunk, (length(s) // 4)::BIGINT AS n FROM m WHERE i = 0
 UNION ALL SELECT m.conv_id, m.i, m.s, CASE WHEN r.n + length(m.s) // 4 > 200 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.n + length(m.s) // 4 > 200 THEN length(m.s) // 4 ELSE r.n + length(m.s) // 4 END FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1)
SELECT conv_id, chunk, min(i) AS start_idx, max(i) AS end_idx, sum(length(s) // 4)::BIGINT AS tokens, string_agg(s, chr(10) ORDER BY i) AS text FROM r GROUP BY conv_id, chunk""")
def i8_session_chunks(t):
    return C.session_chunks(t.conversations, "conv_id", "turn", "role", "text", max_tokens=200)


@query()
def i9_document_chunks(t):
    return C.document_chunks(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id", "text")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '.' || chr(10), '.' || chr(10) || 'Employee: 12345 '), 'page\s+\d+\s+of\s+\d+', '', 'gi'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[^\x00-\x7F]+', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents),
m AS (SELECT *, string_split(regexp_replace(text, '((?:employee|emp|id|number|#)\s*:?\s*[A-Z0-9\-]{3,15})', chr(65535) || '\1', 'gi'), chr(65535)) AS l FROM t),
p AS (SELECT doc_id, text, list_filter(list_transform(CASE WHEN len(l) > 6 THEN l[2:] ELSE string_split_regex(text, '\n\s*\n\s*\n') END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 50) AS l FROM m),
c AS (SELECT doc_id, CASE WHEN len(l) >= 3 THEN l ELSE list_filter(list_transform(range(0, greatest(length(text) - 1, 0) // 2500 + 1), lambda i: regexp_replace(substr(text, i * 2500 + 1, 2500), '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS l FROM p)
SELECT doc_id, generate_subscripts(l, 1) - 1 AS chunk, unnest(l) AS text FROM c""")
def i10_atomic_records(t):
    marked = F.regexp_replace("text", r"\.\n", ".\nEmployee: 12345 ")
    return C.atomic_records(t.documents.select("doc_id", marked.alias("text")), "doc_id", "text")


@query(r"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk, s AS text FROM (SELECT doc_id, i, regexp_replace(substr(text, i * 1000 + 1, 1000), '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 1000 + 1)) AS i FROM documents)) WHERE s <> ''")
def i11_fixed_slices(t):
    return C.fixed_slices(t.documents, "doc_id", F.col("text"), 1000)


@query(_WORD_CHUNKS + """SELECT doc_id || '-' || chunk AS id, doc_id, chunk, past - length(text) AS start, past AS end, sha256(text) AS chunk_hash, CASE WHEN length(text) < 50 THEN 0.2 WHEN length(text) > 5000 THEN 0.5 ELSE 0.9 END AS quality, text
FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk)::BIGINT AS past FROM c)""")
def i12_ingest_chunks(t):
    return C.ingest_chunks(_spaced(t), "doc_id", "text")


_KIND = "CASE role WHEN 'system' THEN NULL ELSE role END"


@query(f"""SELECT conv_id, section, kind, min(turn) AS first, max(turn) AS last FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS section FROM (
 SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, last_value({_KIND} IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS kind FROM conversations) WHERE kind IS NOT NULL)) GROUP BY ALL""")
def e3_sections_by_type(t):
    return C.sections_by_type(t.conversations.withColumn("kind", F.when(F.col("role") != "system", F.col("role"))), "conv_id", "turn", "kind")


@query("SELECT conv_id, anchor, turn AS first, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, n) AS last FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS n, role AS anchor FROM conversations) WHERE role = 'user'")
def e4_sections_by_anchor(t):
    n = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("n"))
    return C.sections_by_anchor(t.conversations.filter("role = 'user'").withColumn("anchor", F.col("role")).join(n, "conv_id"), "conv_id", "turn", "n")


@query("SELECT DISTINCT page_id, name FROM pages, (SELECT 'T' || r_regionkey AS name, lower(substr(r_name, 1, 2)) AS anchor FROM region) WHERE contains(lower(html), anchor)")
def c6_match_anchors(t):
    anchors = t.region.select(F.concat(F.lit("T"), F.col("r_regionkey").cast("string")).alias("name"), F.substring("r_name", 1, 2).alias("anchor"))
    return C.match_anchors(t.pages.select("page_id", "html"), anchors, "html").select("page_id", "name")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS pages FROM conversations GROUP BY conv_id")
def d9_pages_to_document(t):
    return P.pages_to_document(t.conversations, "conv_id", "turn", "text")


@query("SELECT conv_id, count(*) FILTER (WHERE length(trim(text)) > 200) AS native, count(*) FILTER (WHERE length(trim(text)) <= 200) AS needs_ocr, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def d10_page_triage(t):
    return P.page_triage(t.conversations, "conv_id", "text", least=200)


@query("SELECT conv_id, string_agg('=== Page ' || turn || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def a15_render_pages(t):
    return render_pages(t.conversations, "conv_id", "turn", F.col("text"))


@query("SELECT doc_id, source, 'job' AS method, count(*) OVER (PARTITION BY source) AS n FROM documents")
def a12_envelope(t):
    got = with_envelope(t.documents.select("doc_id", "source"), "source", method="job")
    return got.select("doc_id", "source", F.col("metadata.method").alias("method"), F.col("metadata.count").alias("n"))
