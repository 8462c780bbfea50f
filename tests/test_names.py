"""Similar names found by parts of names against the scores of all pairs."""

import random

import pytest

from folioflow.operators import mapping


def names(seed, n):
    rnd = random.Random(seed)
    some = ["id", "name", "cust", "omer", "date", "a", "aa", "_", "-", "Total", "né"]
    return ["".join(rnd.choice(some) for _ in range(rnd.randrange(0, 6))) for _ in range(n)] + ["aaaa", "aaa", "", None, "customer_name", "CustomerName"]


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.85, 0.9, 1.0])
def test_no_similar_pair_is_lost(spark, threshold):
    a = spark.createDataFrame([(x,) for x in names(1, 60)], "s string")
    b = spark.createDataFrame([(x,) for x in names(2, 60)], "u string")
    show = lambda df: sorted((r.s, r.u, round(r.score, 9)) for r in df.collect())
    want = mapping.name_pairs(a, b, "s", "u").filter(f"score >= {threshold}")
    assert show(mapping.similar_pairs(a, b, "s", "u", threshold)) == show(want)


def test_many_names_need_few_candidates(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(6, 16)))
    a, b = [word() for _ in range(3000)], [word() for _ in range(30_000)]
    b[7], b[8] = a[0] + "x", a[1][:-1] + "_q"
    left, right = spark.createDataFrame([(x,) for x in a], "s string"), spark.createDataFrame([(x,) for x in b], "u string")
    share = mapping.candidate_pairs(left, right, "s", "u", 0.7).count() / (len(a) * len(b))
    assert share < 0.01
    best = {r.s: r.u for r in mapping.fuzzy_map(left, right, "s", "u").collect()}
    assert best[a[0]] == b[7] and best[a[1]] == b[8]


def test_empty_lists(spark):
    none = spark.createDataFrame([], "s string")
    assert mapping.similar_pairs(none, none.withColumnRenamed("s", "u"), "s", "u", 0.7).count() == 0
