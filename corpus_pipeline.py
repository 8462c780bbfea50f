"""The corpus pipeline: each stage takes the rows that its predecessor kept, from a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import contamination, language, neardup, pieces, quality
from folioflow.llm.arrow import scratch
from folioflow.llm.language import held_out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those in which no language has half of the words."""
    labelled = docs.filter(~held_out(F.col("doc_id"), 3, 1))
    langs, table = language.train(labelled, F.col("text"), F.col("lang"), F.col("doc_id"))
    found = language.identify(docs.withColumn("__row", F.struct(*docs.columns)).select("__row"), F.col("__row.text"), langs, table)
    return found.filter("lang_pred <> 'und' and score >= 0.5").select("__row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are mostly boilerplate lines."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("text"), "doc_id", "quality")
    found = quality.assess(docs.select(F.struct(*docs.columns).alias("__row")), F.col("__row.text"), model)
    return found.filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each class of near or exact copies."""
    return neardup.keep_one(docs, F.col("text"), "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of whose words a twentieth or more are inside of benchmark windows."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.scan(docs.select(F.struct(*docs.columns).alias("__row")), F.col("__row.text"), bench, F.col("item_id"), F.col("text"))
    return found.filter(~contamination.contaminated(F.col("n_words"), contamination.n_hit(F.col("hits")))).select("__row.*")


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of each text's ids, their digest and that of the text that they decode to."""
    import public_tokenizers

    return pieces.round_trip(docs, F.col("text"), pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("language", language_id), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pieces", piece_ids)]

#: Language identification and quality rules decide by trained models and pieces need a vocabulary, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
