"""Sharding by Karmarkar-Karp differencing over indivisible groups of rows."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import written

#: Bins of groups that the one task differences, besides half as many groups.
GROUPS_A_TASK = 50_000
#: Parts of each shard whose rows are numbered by a task.
SALTS = 256


def difference(partials: list[tuple[int, ...]], ways: int) -> tuple[tuple[int, ...], list[tuple[int, ...]]]:
    """The sums of the ways, and for each partial partition the way that each of its parts goes to.

    The two partial partitions of largest spread are combined again and again, the largest part of one with the
    smallest of the other. Ties go by the order given.
    """
    heap = []
    for i, p in enumerate(partials):
        order = sorted(range(len(p)), key=lambda k: (-p[k], k))
        sums = tuple(p[k] for k in order) + (0,) * (ways - len(p))
        heap.append((sums[-1] - sums[0], i, sums, [((i, k),) for k in order] + [()] * (ways - len(p))))
    if not heap:
        return (0,) * ways, []
    heapq.heapify(heap)
    count = len(partials)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((a[k] + b[-1 - k], k) for k in range(ways)), key=lambda v: (-v[0], v[1]))
        # kept as pairs of trees, so that combining costs the number of ways and not of members
        heapq.heappush(heap, (both[-1][0] - both[0][0], count, tuple(v for v, _ in both), [(x[k], y[-1 - k]) for _, k in both]))
        count += 1
    _, _, sums, trees = heap[0]
    to = [[0] * len(p) for p in partials]
    for way, tree in enumerate(trees):
        stack = [tree]
        while stack:
            node = stack.pop()
            for child in node:
                if child and isinstance(child[0], int):
                    to[child[0]][child[1]] = way
                elif child:
                    stack.append(child)
    return sums, [tuple(x) for x in to]


def assign(groups: DataFrame, shards: int) -> tuple[DataFrame, list[int]]:
    """groups (g, bytes) with shard; and the shards' sums.

    Groups are told by classes of size, each of about a hundredth. As many of the highest classes as have half of
    GROUPS_A_TASK groups together are items one by one; the other groups are dealt by hash into GROUPS_A_TASK bins,
    and a bin is an item. The rule is one at all sizes, one group more or less moves a class at most, and the items' number is
    bounded. What is heavy against a shard is among the highest, in the same heap with all that can offset it.
    """
    groups = written(groups.select("g", "bytes"), "shard-groups")
    rank = F.floor(64 * F.log2(F.col("bytes") + 1))
    left, least = GROUPS_A_TASK // 2, None
    for r in sorted(groups.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["rank"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["rank"]
    single = F.lit(False) if least is None else rank >= least
    binned = F.pmod(F.xxhash64("g"), F.lit(GROUPS_A_TASK)).cast("string").cast("binary")
    dealt = groups.withColumn("item", F.when(single, F.concat(F.lit(b"g"), "g")).otherwise(F.concat(F.lit(b"b"), binned)))

    def local(key, table):
        table = table.sort_by([("bytes", "descending"), ("item", "ascending")])
        _, to = difference([(x,) for x in table.column("bytes").to_pylist()], shards)
        return table.append_column("shard", pa.array([x[0] for x in to], pa.int32()))

    items = dealt.groupBy("item").agg(F.sum("bytes").alias("bytes")).withColumn("heap", F.lit(0))
    placed = written(items.groupBy("heap").applyInArrow(local, "item binary, bytes long, heap int, shard int"), "shard-items")
    sums = {r["shard"]: r["s"] for r in placed.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()}
    return dealt.join(placed.select("item", "shard"), "item").select("g", "shard"), [sums.get(k, 0) for k in range(shards)]


def shard(df: DataFrame, text: Column, order: Column, shards: int = 16) -> DataFrame:
    """Order as `key`, size, text_crc32, shard and slot of each row, under the law `bytes`; all columns of df are left out.

    A row's size is the UTF-8 bytes of its text plus 1; a null text has none and goes with the empty ones. Rows with
    equal texts stay together, whatever their number. slot counts the rows of a shard from 0 without gaps, by salts of
    the row's number in its file, so that rows that repeat are dealt too, and within them by key; rows of equal keys (or
    null keys) are in some order. An empty table gives
    no rows.
    """
    raw = F.coalesce(text, F.lit(""))
    rows = df.select(order.alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("g"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "shard-rows")
    where, _ = assign(rows.groupBy("g").agg(F.sum("size").alias("bytes")), shards)
    placed = written(rows.join(where, "g").select("key", "size", "text_crc32", "shard", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")), "shard-placed")
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "salt").orderBy("key", "size", "text_crc32")
    return (
        placed.withColumn("i", F.row_number().over(within) - 1)
        .join(counts, ["shard", "salt"])
        .select("key", "size", "text_crc32", "shard", (F.col("i") + F.col("before")).cast("long").alias("slot"))
    )
