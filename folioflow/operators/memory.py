"""Memories, sessions, versions and lineage."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.sources.shared import written


def not_expired(expires: Column, now: Column) -> Column:
    """No expiry, or one after now."""
    return expires.isNull() | (expires > now)


def search_memories(df: DataFrame, user=None, title=None, status=None, tags: list[str] | None = None, limit: int = 50) -> DataFrame:
    """All filters first, then the newest (by created, id)."""
    for cond in (
        F.col("user") == user if user is not None else None,
        F.lower("title").contains(title.lower()) if title else None,
        F.col("status") == status if status else None,
        F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else None,
    ):
        df = df if cond is None else df.filter(cond)
    return df.sort(F.desc("created"), "id").limit(limit)


def latest_active(df: DataFrame, keys: list[str], at: str, key: str) -> DataFrame:
    """Of each title (and user) the latest active memory; an aggregate of one row for each key and task."""
    live = df.filter("status = 'active'")
    return live.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(at, key)).alias("r")).select("r.*")


def compact_memories(df: DataFrame, now: int, days: int = 30, max_importance: float = 0.3, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Per user the oldest entries (most at most) older than days and of no more importance become one, their texts joined and cut at 500 characters; returns (kept and new, removed)."""
    old = df.filter((now - F.col("created") > days) & (F.col("importance") <= max_importance))
    order = Window.partitionBy("user").orderBy("created", "id")
    chosen = old.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")
    parts = F.array_sort(F.collect_list(F.struct("created", "id", "text")))
    made = chosen.groupBy("user").agg(F.min("id").alias("id"), F.max("created").alias("created"), F.max("importance").alias("importance"), F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), "\n"), 1, 500).alias("text"))
    rest = df.join(chosen.select("id"), "id", "left_anti")
    return rest.unionByName(made.select(*df.columns)), chosen


def expire(df: DataFrame, expires: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and the number that goes."""
    gone = ~not_expired(F.col(expires), now)
    return df.filter(~gone), df.agg(F.count_if(gone).alias("expired"))


def user_stats(sessions: DataFrame, memories: DataFrame, structures: DataFrame, user: str) -> DataFrame:
    """Counts of each, for users of any."""
    n = lambda df, name: df.groupBy(user).agg(F.count("*").alias(name))
    both = n(sessions, "sessions").join(n(memories, "memories"), user, "full").join(n(structures, "structures"), user, "full")
    return both.na.fill(0, ["sessions", "memories", "structures"])


def session_view(messages: DataFrame, session: str, turn: str, columns: list[str], at: str) -> DataFrame:
    """Messages of each session in order, and its last activity."""
    return messages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(turn, *columns))).alias("messages"), F.max(at).alias("last_activity"))


def apply_access(memories: DataFrame, reads: DataFrame, key: str, at: str) -> DataFrame:
    """access_count and last_accessed moved by the reads."""
    sums = reads.groupBy(key).agg(F.count("*").alias("__n"), F.max(at).alias("__at"))
    return memories.join(sums, key, "left").withColumns({"access_count": F.col("access_count") + F.coalesce("__n", F.lit(0)), "last_accessed": F.greatest("last_accessed", "__at")}).drop("__n", "__at")


def update_memory(nodes: DataFrame, edges: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K7: each update (id, new_id, text) makes a new version that inherits the fields, an edge `updates` to the old one, and deprecates that."""
    old = nodes.join(updates.select("id", "new_id"), "id", "left")
    kept = old.withColumns({"status": F.when(F.col("new_id").isNotNull(), "deprecated").otherwise(F.col("status")), "replaced_by": F.coalesce("new_id", "replaced_by")}).select(*nodes.columns)
    made = nodes.drop("text", "status", "replaced_by").join(updates, "id").withColumns({"id": F.col("new_id"), "status": F.lit("active"), "replaced_by": F.lit(None).cast(dict(nodes.dtypes)["replaced_by"])})
    edge = updates.select(F.col("new_id").alias("src"), F.col("id").alias("dst"), F.lit("updates").alias("type"))
    return kept.unionByName(made.select(*nodes.columns)), edges.unionByName(edge).distinct()


def memory_history(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, step, node): each id's chain of predecessors along `updates` edges (src updates dst), from itself at step 0.

    Chains are followed by doubling to their ends: after k joins every node knows its ancestors up to 2**k steps, so
    long chains take few joins; each round's new pairs are written to a shared folder. A cycle ends where a node comes
    again, since pairs already reached are left out.
    """
    hop = edges.filter("type = 'updates'").groupBy("src").agg(F.min("dst").alias("dst")).filter("src <> dst")
    reach = written(hop.select(F.col("src").alias("id"), F.lit(1).alias("step"), F.col("dst").alias("node")), "history")
    length = 1
    while True:
        # what is reached in exactly `length` steps goes on with that node's own chain
        tips = reach.filter(F.col("step") == length)
        further = tips.join(reach.select(F.col("id").alias("node"), F.col("step").alias("s"), F.col("node").alias("n")), "node").select("id", (F.col("step") + F.col("s")).alias("step"), F.col("n").alias("node"))
        further = written(further.filter("id <> node").join(reach.select("id", "node"), ["id", "node"], "left_anti").select("id", "step", "node"), "history")
        if further.isEmpty():
            break
        reach = reach.unionByName(further)
        length *= 2
    whole = ids.select("id", F.lit(0).alias("step"), F.col("id").alias("node")).unionByName(reach.join(ids.select("id"), "id", "left_semi"))
    return whole.groupBy("id", "node").agg(F.min("step").alias("step")).select("id", "step", "node")


def add_version(templates: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The history with a further version (highest + 1, draft) for each change."""
    top = templates.groupBy(key).agg(F.max("version").alias("__v"))
    new = changes.join(top, key, "left").withColumns({"version": F.coalesce("__v", F.lit(0)) + 1, "status": F.lit("draft")}).drop("__v")
    return templates.unionByName(new.select(*templates.columns))


def publish(templates: DataFrame, key: str) -> DataFrame:
    """The highest version of each is published, lower published ones become archived."""
    top = templates.groupBy(key).agg(F.max("version").alias("__v"))
    status = F.when(F.col("version") == F.col("__v"), "published").when(F.col("status") == "published", "archived").otherwise(F.col("status"))
    return templates.join(top, key).withColumn("status", status).drop("__v")


def soft_delete(templates: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return templates.join(gone.select(key, F.lit(True).alias("__gone")), key, "left").withColumn("deleted", F.col("__gone").isNotNull()).drop("__gone")


def history(templates: DataFrame, key: str) -> DataFrame:
    """All versions, the newest of each first."""
    return templates.sort(key, F.desc("version"))


def current_version(templates: DataFrame, key: str) -> DataFrame:
    return templates.groupBy(key).agg(F.max_by(F.struct(*templates.columns), "version").alias("r")).select("r.*")


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]|[^\s{}\[\],:"]+', re.S)


def _leaves(text: str) -> tuple[list[str], list[str | None], list[bool]]:
    """Paths and values of the scalars within containers of valid JSON; and which values are numbers to be shown as doubles."""
    paths: list[str] = []
    values: list[str | None] = []
    wide: list[bool] = []
    at: list[str | int | None] = []  # where we are in each open container: the index, or the key (None until it is read)
    for m in _JSON.finditer(text):
        x = m[0]
        c = x[0]
        if c == ",":
            at[-1] = at[-1] + 1 if isinstance(at[-1], int) else None
        elif c in "]}":
            at.pop()
        elif c in "[{":
            at.append(0 if c == "[" else None)
        elif at and at[-1] is None:
            at[-1] = json.loads(x) if "\\" in x else x[1:-1]
        elif at:
            number = c == "-" or c.isdigit()
            paths.append(".".join(map(str, at)))
            wide.append(number and ("e" in x or "E" in x or sum(map(str.isdigit, x)) > 38))
            if c == '"':
                x = json.loads(x) if "\\" in x else x[1:-1]
            elif number and "." in x and not wide[-1]:
                x = x.rstrip("0").rstrip(".")
                x = "0" if x == "-0" else x
            values.append(None if x == "null" and c == "n" else x)
    return paths, values, wide


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """H7: (key, path, value): the scalar leaves of JSON text by dotted path, arrays by index; empty containers and what is no JSON give none.

    One narrow pass, whatever the depth: a scanner goes over each text once and keeps the path that it is on. Numbers
    are shown as Spark shows them: those with an exponent as doubles, others without zeros at a fraction's end.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.try_parse_json("text").isNotNull())
    schema = T.StructType([rows.schema["key"], T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("wide", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, columns = [], ([], [], [])
            for i, x in enumerate(b.column(1).to_pylist()):
                found = _leaves(x)
                row += [i] * len(found[0])
                for own, more in zip(columns, found, strict=True):
                    own += more
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)]], names=schema.names)

    value = F.when(F.col("wide"), F.col("value").cast("double").cast("string")).otherwise(F.col("value"))
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), "path", value.alias("value"))
