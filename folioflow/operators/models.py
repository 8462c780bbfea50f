"""Jobs around a model function that the caller gives (K1-K5)."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.batches import with_columns
from folioflow.functions.hashing import protect
from folioflow.functions.replies import reply_records
from folioflow.functions.text import keywords_simple
from folioflow.operators.records import complete_to_schema, dedupe_signature, merge_subset, verify_changes
from folioflow.sources.shared import written


def model_map(df: DataFrame, prompt: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """K1: df with reply and error. make() is called once a task and gives the function of a batch of prompts.

    A batch that fails is tried again after a delay that doubles, 60 s at most; then its rows have an error. Order stays, and so do all
    other columns, of whatever type.
    """
    at = df.columns.index(prompt)

    def start() -> Callable[[pa.RecordBatch], list]:
        call = make()

        def ask(b: pa.RecordBatch) -> list:
            replies: list[str | None] = []
            errors: list[str | None] = []
            prompts = b.column(at).to_pylist()
            for i in range(0, len(prompts), batch):
                some = prompts[i : i + batch]
                for k in range(retries + 1):
                    try:
                        got, error = list(call(some)), None
                        if len(got) != len(some):
                            raise ValueError(f"{len(got)} replies to {len(some)} prompts")
                        break
                    except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                        got, error = [None] * len(some), str(e)[:500]
                        if k < retries:
                            time.sleep(min(60.0, wait * 2**k))
                replies += got
                errors += [error] * len(some)
            return [replies, errors]

        return ask

    return with_columns(df, start, [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])


def tiered_map(df: DataFrame, prompt: str, order: str, small: Callable, large: Callable, first: int = 10, cut: int = 1500, **options) -> DataFrame:
    """K2: the first prompts by order go to the small model, the others, cut at so many characters, to the large one in pairs; what fails goes to the other, then once more to the first. tier tells which.

    The replies of each attempt are written before they are parted, so that a prompt is asked once an attempt.
    """
    head = df.filter(F.col(order) < first)
    tail = df.filter(F.col(order) >= first).withColumn(prompt, F.substring(prompt, 1, cut))

    def ask(rows: DataFrame, a: Callable, b: Callable, names: tuple[str, str], size: int) -> DataFrame:
        one = written(model_map(rows, prompt, a, batch=size, **options).withColumn("tier", F.lit(names[0])), "tier")
        failed = one.filter("error is not null").select(*df.columns)
        two = written(model_map(failed, prompt, b, batch=size, **options).withColumn("tier", F.lit(names[1])), "tier")
        last = model_map(two.filter("error is not null").select(*df.columns), prompt, a, batch=size, **options).withColumn("tier", F.lit(names[0]))
        last = written(last, "tier")
        return one.filter("error is null").unionByName(two.filter("error is null")).unionByName(last)

    return ask(head, small, large, ("small", "large"), 1).unionByName(ask(tail, large, small, ("large", "small"), 2))


def extract_records(chunks: DataFrame, key: str, prompt: str, fields: list[str], make: Callable, **options) -> DataFrame:
    """K3: chunks through the model to records of exactly the fields, without records that repeat or are empty."""
    replies = model_map(chunks.select(key, prompt), prompt, make, **options).filter("error is null")
    rows = reply_records(replies, key, "reply").filter("record is not null")
    wide = rows.select(key, "i", *[F.get_json_object("record", f"$['{f}']").alias(f) for f in fields])
    kept = dedupe_signature(wide, fields, [key, "i"])
    return complete_to_schema(kept.select(key, "i", *fields), fields)


def guarded_update(df: DataFrame, key: str, cond: Column, edit: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """K4: the rows of the condition, protected, edited, verified by digest and merged back by key; returns the table and the verdicts."""
    protected = protect(df.filter(cond))
    verdicts = verify_changes(protected, edit(protected))
    changed = verdicts.filter("status = 'modified'").select(*df.columns)
    return merge_subset(df, changed, key), verdicts


def extract_memories(messages: DataFrame, key: str, text: str, make: Callable, **options) -> DataFrame:
    """K5: facts from messages of over 50 characters: id, key, fact, confidence (0.8), importance (0.5), status, keywords; a reply without records gives the whole text."""
    long = messages.filter(F.length(text) > 50).select(key, text)
    replies = model_map(long, text, make, **options)
    found = reply_records(replies.withColumn("reply", F.coalesce("reply", F.lit(""))), key, "reply").join(long, key)
    fact = F.coalesce(F.get_json_object("record", "$.fact"), F.col("record"), F.col(text))
    number = lambda name, value: F.coalesce(F.get_json_object("record", f"$.{name}").try_cast("double"), F.lit(value))
    return found.select(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col("i"), F.lit(0)).cast("string")), 256).alias("id"), key, fact.alias("fact"), number("confidence", 0.8).alias("confidence"), number("importance", 0.5).alias("importance"), F.lit("active").alias("status"), keywords_simple(fact).alias("keywords"))
