"""The pipeline: each stage against a plain version on its own input."""

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_counts import brute_contamination, brute_quality, plain_mixture
from test_neardup import brute

import corpus_pipeline
from folioflow.llm import language, quality


def plain_language(spark, docs, sf):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in docs.values()], "doc_id long, text string, lang string")
    langs, table = language.train(df.filter(~language.held_out(F.col("doc_id"), 3, 1)), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = {k: plain_mixture(r["text"] or "", langs, table) for k, r in docs.items()}
    return {k for k, x in found.items() if x and max(x.values()) >= 0.5}


def plain_quality(spark, docs, sf):
    """Base rules by brute force; labels of lines by the best of all paths, kept as lists."""
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs.values()], "doc_id long, text string")
    w, move, share = quality.train(df, spark.read.parquet(f"{sf}/labels.parquet"), F.col("text"), "doc_id", "quality")
    kept = set()
    for k, r in docs.items():
        own = quality.Texts([(r["text"] or "").encode()])
        if brute_quality(r["text"])[-1]:
            continue
        paths = [(0.0, []), (0.0, [])]
        for i, score in enumerate((own.features.astype(float) @ w).tolist()):
            ways = [[(paths[a][0] + (move[a][b] if i else 0) + b * score, [*paths[a][1], b]) for a in (1, 0)] for b in (0, 1)]
            paths = [max(x, key=lambda p: p[0]) for x in ways]
        states = max((paths[1], paths[0]), key=lambda p: p[0])[1]
        content = sum(n for n, s in zip(own.line_chars.tolist(), states) if s)
        if content / max(own.line_chars.sum(), 1) >= share:
            kept.add(k)
    return kept


def plain_near_duplicates(spark, docs, sf):
    classes, _ = brute([(k, r["text"]) for k, r in docs.items()])
    return set(classes.values())


def plain_decontamination(spark, docs, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return {k for k, x in brute_contamination({k: r["text"] for k, r in docs.items()}, items).items() if not x[-1]}


PLAIN = {"language": plain_language, "quality": plain_quality, "near_duplicates": plain_near_duplicates, "decontamination": plain_decontamination, "pieces": lambda spark, docs, sf: set(docs)}


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_stages(spark, folder):
    sf = f"/root/testdata/{folder}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(PLAIN)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = {r["doc_id"]: r for r in out.collect()}
        assert all(after[k][c] == before[k][c] for k in after for c in columns)
        assert name == "pieces" or out.columns == columns
        assert set(after) == PLAIN[name](spark, before, sf), name
        if name == "pieces":
            assert all(r["n_tokens"] == len(library.encode(r["text"])) for r in after.values())
        docs = spark.createDataFrame([tuple(r[c] for c in out.columns) for r in after.values()], out.schema)


def test_stages_leave_good_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert stages["language"](spark, docs, sf).count() > 0.95 * docs.count()
    kept = {r["doc_id"] for r in stages["quality"](spark, docs, sf).collect()}
    good, bad = ([k for k in labels if labels[k] == y] for y in (1, 0))
    assert sum(k in kept for k in good) > 0.97 * len(good) and sum(k in kept for k in bad) < 0.05 * len(bad)


CLASH = "lang_pred score kept n_words content_share key g label class_id hits items n_tokens ids_sha256 row own_key".split()


def test_odd_documents(spark, sf):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in CLASH)])
    text = " ".join(f"word{i} and" for i in range(60)) + "."
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, text, "en", "a", 5), (3, text, "en", "a", 5), (None, text + " more", None, "b", 1)]
    for name, stage in corpus_pipeline.STAGES:
        for given in ([(*r, *range(len(CLASH))) for r in rows], []):
            out = stage(spark, spark.createDataFrame(given, schema), sf)
            found = out.collect()
            assert len(found) <= len(given)
            if name != "pieces":
                assert out.columns == schema.names and all(r[c] == i for r in found for i, c in enumerate(CLASH))
            else:
                assert set(schema.names) <= set(out.columns) and len(found) == len(given)
