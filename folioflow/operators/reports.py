"""Lists and summaries over documents, jobs, sessions, events and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import field_card


def list_live(df: DataFrame, deleted: str, name: str, contains: str | None = None, status: str | None = None, order: list[Column] = ()) -> DataFrame:
    """Rows that are not deleted, of the status if given, whose name holds the text in any case."""
    live = df.filter(F.col(deleted).isNull())
    live = live if status is None else live.filter(F.col("status") == status)
    live = live if contains is None else live.filter(F.lower(name).contains(contains.lower()))
    return live.sort(*order) if order else live


def newest(df: DataFrame, where: Column | None, at: str, tie: str, limit: int) -> DataFrame:
    """The rows of the condition, the newest first, so many at most: a top-k of each task, then of those."""
    rows = df if where is None else df.filter(where)
    return rows.sort(F.desc(at), tie).limit(limit)


def parent_child(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: list[str]) -> DataFrame:
    """Each parent's rows beside its children's, in order."""
    return parents.join(children, parents[parent_key] == children[child_key]).sort(*order)


def audit_stats(events: DataFrame, category: str, at: str) -> DataFrame:
    """Of each category its events, the first, the last and the seconds between."""
    first, last = F.min(at), F.max(at)
    return events.groupBy(category).agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"), F.timestamp_diff("SECOND", first, last).alias("seconds"))


def processing_summary(df: DataFrame, group: str, done: Column) -> DataFrame:
    """Of each group all rows, those that are done and the others."""
    good = F.coalesce(done, F.lit(False))
    return df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(good).alias("processed"), F.count_if(~good).alias("errors"))


def dashboard(events: DataFrame, at: str, user: str, failed: Column) -> DataFrame:
    """Of each day its events, users and errors."""
    return events.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("events"), F.countDistinct(user).alias("users"), F.count_if(failed).alias("errors"))


def joined_in_order(df: DataFrame, key: str, order: str, said: Column, sep: str, name: str) -> DataFrame:
    """The texts of each key in order as one, with their number: a row's text is by definition one value."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order), said.alias("__said"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["__said"]), sep).alias(name), F.count("*").alias("n"))


def pages_to_document(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """A document's pages as one text, and how many they are."""
    return joined_in_order(pages, key, page, F.col(text), "\n", "text").withColumnRenamed("n", "pages")


def page_triage(pages: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """Of each document the pages with more than so many characters, the others, and all characters."""
    native = F.coalesce(F.length(F.trim(text)) > least, F.lit(False))
    return pages.groupBy(key).agg(F.count_if(native).alias("native"), F.count_if(~native).alias("needs_ocr"), F.sum(F.length(text)).alias("chars"))


def vector_counts(vectors: DataFrame, collection: str) -> DataFrame:
    """D15."""
    return vectors.groupBy(collection).agg(F.count("*").alias("n"))


def top_structures(uses: DataFrame, structure: str, at: str, limit: int = 20) -> DataFrame:
    """the most used structures, the latest first among equals: n and last."""
    sums = uses.groupBy(structure).agg(F.count("*").alias("n"), F.max(at).alias("last"))
    return sums.sort(F.desc("n"), F.desc("last"), structure).limit(limit)


def user_sessions(events: DataFrame, session: str, at: str, limit: int) -> DataFrame:
    """sessions by their last activity."""
    return events.groupBy(session).agg(F.max(at).alias("last")).sort(F.desc("last"), session).limit(limit)


def ordered_distinct(df: DataFrame, group: str, value: str, order: str, limit: int = 64) -> DataFrame:
    """Each group's values by first occurrence, so many at most.

    Repeats go in an aggregate first, and of what is left only a group's first ones are kept.
    """
    from pyspark.sql import Window

    first = df.groupBy(group, value).agg(F.min(order).alias("__first"))
    ranked = first.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy("__first", value)))
    return ranked.filter(F.col("__rank") <= limit).drop("__first", "__rank")


def template_card(fields: DataFrame, template: str, order: str, name: Column, kind: Column, notes: Column) -> DataFrame:
    """A template's fields, a line each."""
    return joined_in_order(fields, template, order, field_card(name, kind, notes), "\n", "card").drop("n")


def render_prompt(messages: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation as one prompt, each message behind its speaker."""
    # fixed values: how speakers are shown
    speaker = F.when(F.col(role) == "system", "System: ").when(F.col(role) == "assistant", "Assistant: ").otherwise("User: ")
    return joined_in_order(messages, session, turn, F.concat(speaker, F.coalesce(F.col(text), F.lit(""))), "\n\n", "prompt").drop("n")
