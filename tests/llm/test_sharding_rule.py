"""One rule of sharding at all sizes: a group more doesn't deal the others anew."""

from folioflow.llm import sharding


def test_more_groups_than_the_limit_bin_the_least_only(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_A_TASK", 400)
    sizes = [100 + 37 * i for i in range(200)] + [5] * 201
    made = []
    monkeypatch.setattr(sharding, "written", lambda df, name: made.append((name, df.cache())) or made[-1][1])
    for n in (200, 400, 401):
        groups = spark.createDataFrame([(str(i).encode(), x) for i, x in enumerate(sizes[:n])], "g binary, bytes long")
        where, sums = sharding.assign(groups, 4)
        assert where.count() == n and sum(sums) == sum(sizes[:n])
    alone = [{bytes(r["item"]) for r in df.collect() if bytes(r["item"])[:1] == b"g"} for name, df in made if name == "shard-items"]
    assert alone[0] == alone[1] == alone[2] == {f"g{i}".encode() for i in range(200)}
