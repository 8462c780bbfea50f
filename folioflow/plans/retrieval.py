"""Queries over keywords and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import hashing as H
from folioflow.functions import text as X
from folioflow.operators import kept_index as K
from folioflow.operators import reports as P
from folioflow.operators import retrieval as R
from folioflow.plans.registry import query

_STOP = ", ".join(f"'{w}'" for w in X.INDEX_STOP_WORDS)
_COUNTS = rf"""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+')) AS keyword FROM documents),
c AS (SELECT doc_id, keyword, count(*) AS n FROM w WHERE strlen(keyword) >= 2 AND keyword NOT IN ({_STOP}) GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id)::BIGINT AS word_count, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS i, count(*) OVER (PARTITION BY keyword) AS df FROM c),
postings AS (SELECT doc_id, keyword, n, n / word_count AS tf, df, word_count FROM p WHERE i <= 50)
"""
_WORDS = ["thin", "anan", "shbe"]


@query(_COUNTS + "SELECT doc_id, keyword, n, round(tf, 9) AS tf, df, word_count FROM postings")
def d1_keyword_index(t):
    got = R.keyword_index(t.documents, "doc_id", "text")
    return got.withColumn("tf", F.round("tf", 9))


@query(_COUNTS + "SELECT keyword, count(*) AS n FROM (SELECT doc_id, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, keyword) AS r FROM postings) WHERE r <= 5 GROUP BY keyword")
def e6_top_keywords(t):
    return R.postings(R.keyword_counts(t.documents, "doc_id", "text", 5), "doc_id", top=5).groupBy("keyword").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, source AS keyword, 0.5 AS tf FROM documents UNION ALL SELECT doc_id, lang, 0.5 FROM documents""")
def d2_uniform_postings(t):
    return R.uniform_postings(t.documents, "doc_id", F.array("source", "lang"))


def _search(t, k=20):
    asked = t.documents.filter("doc_id % 100 = 0").select("doc_id", F.explode(X.keywords_simple(F.col("text"), 6)).alias("keyword")).select(F.col("doc_id").alias("query"), "keyword")
    live = t.documents.filter("lang = 'en'")  # known before the index is built, so only these documents are indexed
    return R.keyword_search(R.postings(R.keyword_counts(live, "doc_id", "text", 50), "doc_id"), live, asked, "doc_id", k)


_SIMPLE = ", ".join(f"'{w}'" for w in X.SIMPLE_STOP_WORDS)
_SEARCH = _COUNTS + rf""", a AS (SELECT doc_id AS query, w AS keyword FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+') AS l FROM documents WHERE doc_id % 100 = 0)) WHERE length(w) > 2 AND w NOT IN ({_SIMPLE}) GROUP BY doc_id, w)) WHERE r <= 6),
f AS (SELECT query, doc_id, count(*) AS match_count, sum(tf) AS total_tf FROM postings JOIN a USING (keyword) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match_count DESC, round(total_tf, 9) DESC, doc_id) - 1 AS rank FROM f)
"""


@query(_SEARCH + "SELECT query, doc_id, match_count, round(total_tf, 6) AS total_tf, rank, round(1 / (rank + 1), 6) AS score FROM s WHERE rank < 20")
def c1_keyword_search(t):
    return _search(t).select("query", "doc_id", "match_count", F.round("total_tf", 6).alias("total_tf"), "rank", F.round("score", 6).alias("score"))


def _kept(t, k):
    """The same search in an index of all documents that is written first."""
    asked = t.documents.filter("doc_id % 100 = 0").select("doc_id", F.explode(X.keywords_simple(F.col("text"), 6)).alias("keyword")).select(F.col("doc_id").alias("query"), "keyword")
    return K.search(K.build(t.documents, "doc_id", "text"), t.documents.filter("lang = 'en'"), asked, k)


@query(_SEARCH + "SELECT query, doc_id, match_count, round(total_tf, 6) AS total_tf, rank, round(1 / (rank + 1), 6) AS score FROM s WHERE rank < 20")
def c1_kept_index(t):
    return _kept(t, 20)[0].select("query", "doc_id", "match_count", F.round("total_tf", 6).alias("total_tf"), "rank", F.round("score", 6).alias("score"))


@query(_SEARCH + "SELECT query, sum(round(1 / (rank + 1), 6)) AS score, count(*) AS n FROM s WHERE rank < 20 GROUP BY query")
def e1_rank_score(t):
    return _search(t).groupBy("query").agg(F.sum(F.round("score", 6)).alias("score"), F.count("*").alias("n"))


_DIST = "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = f"""SELECT q, v, distance, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), v) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 {{where}})"""


def _asked(t):
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("v"), "embedding", "label")


@query(f"SELECT q, v, round(distance, 6) AS distance, rank FROM ({_KNN.format(where='AND b.label >= 2')}) WHERE rank <= 10")
def c7_knn(t):
    got = R.knn(_asked(t), _vectors(t), "q", "v", "embedding", 10, F.col("label") >= 2)
    return got.select("q", "v", F.round("distance", 6).alias("distance"), "rank")


@query()
def c8_lsh_knn(t):
    return R.lsh_knn(_asked(t), _vectors(t), "q", "v", "embedding", 10)


@query("SELECT doc_id, sha256(text) AS key, length(text) AS value FROM documents")
def c9_with_cache(t):
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("key"), F.length("text").alias("n"))
    values = keyed.select("key", F.col("n").alias("value")).distinct()
    cache = values.filter("substr(key, 1, 1) < '8'")
    return R.with_cache(keyed.drop("n"), cache, "key", lambda misses: values.join(misses, "key"))


@query("SELECT doc_id, round(sin(h), 6) AS a, round(cos(h), 6) AS b, round((h % 7) / 7.0, 6) AS c FROM (SELECT doc_id, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 1000 AS h FROM documents)")
def k6_embed(t):
    none = t.spark.createDataFrame([], "key string, v array<double>")
    got = R.embed(t.documents.select("doc_id", "text"), "text", "stub", lambda m: m.select("key", H.hash_embedding(F.col("text")).alias("v")), none)
    return got.select("doc_id", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate("abc")])


@query("SELECT doc_id, round(sin(h), 6) AS a FROM (SELECT doc_id, ('0x' || substr(sha256(text), 1, 8))::BIGINT % 1000 AS h FROM documents)")
def h40_hash_embedding(t):
    return t.documents.select("doc_id", F.round(H.hash_embedding(F.col("text"))[0], 6).alias("a"))


@query(f"SELECT a.vec_id AS q, b.vec_id AS v, round({_DIST.replace('1 - ', '')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h39_cosine(t):
    a = t.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("q"), F.col("vec_id").alias("v"), F.col("embedding").alias("y"))
    return a.join(b, "q").select("q", "v", F.round(H.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("SELECT label, i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def h39_mean_pool(t):
    return R.mean_pool(t.embeddings, "label", "embedding").select("label", F.posexplode("mean").alias("i", "x")).withColumn("x", F.round("x", 6))


_NEAREST = f"SELECT q, v, distance, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), v) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, {_DIST} AS distance FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i = 1 THEN 0.05 * (vec_id // 100) ELSE 0 END) AS embedding FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b)"


@query(f"SELECT q, v, round(1 - distance, 4) AS similarity FROM ({_NEAREST}) WHERE rank = 1 AND round(1 - distance, 4) >= 0.4")
def f4_classify_template(t):
    # asked with copies of which the first place is moved further and further, so that some pass the gate and some don't
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i == 0, 0.05 * F.floor(F.col("q") / 100)).otherwise(0.0))
    return R.classify_template(_asked(t).withColumn("embedding", moved), _vectors(t), "q", "v", "embedding")


@query(_SEARCH + f""", n AS (SELECT q AS query, v AS doc_id, distance, rank FROM (SELECT q, v, distance, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), v) AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS v, {_DIST} AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 20),
m AS (SELECT query, doc_id, round(sum(score), 4) AS score FROM (SELECT query, doc_id, 0.3::DOUBLE / (rank + 1) AS score FROM s WHERE rank < 30 UNION ALL SELECT query, doc_id, 0.7::DOUBLE * greatest(0, 1 - distance) FROM n) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY ALL)
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 10""")
def g1_hybrid_retrieve(t):
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
    near = R.knn(asked, t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "query", "doc_id", "embedding", 20)
    kinds = t.documents.select("doc_id", F.col("lang").alias("kind"))
    return R.hybrid_retrieve(_search(t, 30), near, kinds, "query", "doc_id", "en")


@query(r"""SELECT doc_id, chunk FROM (SELECT doc_id, chunk, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk DESC) AS r FROM (
 SELECT doc_id, i AS chunk, contains(lower(s), 'the')::INT + contains(lower(s), 'ment')::INT AS score FROM (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS s FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) // 500 + 1)) AS i FROM documents)))) WHERE r <= greatest(3, n // 2)""")
def e7_select_chunks(t):
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(500))
    chunks = t.documents.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substr(F.col("text"), i, F.lit(500)))).alias("chunk", "s"))
    return R.select_chunks(chunks.select("doc_id", "chunk", X.keyword_score(F.col("s"), ["the", "ment"]).alias("score")), "doc_id", "chunk", "score").select("doc_id", "chunk")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def d15_vector_counts(t):
    return P.vector_counts(t.embeddings, "label")


@query("SELECT lang, unnest(list_slice(l, 1, 64)) AS source FROM (SELECT lang, list(source ORDER BY i) AS l FROM (SELECT lang, source, min(doc_id) AS i FROM documents GROUP BY ALL) GROUP BY lang)")
def g2_ordered_distinct(t):
    return P.ordered_distinct(t.documents, "lang", "source", "doc_id")
