import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        free -= over
        if not free:
            return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1, None: 50}, {"a": 5}, {"a": 0, "b": 7}, {"b": 1000, "a": 1, "c": 1, "d": 1, "e": 2}, {"a": 10, "b": 10, "c": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(plain_targets(sizes))


def test_mix(spark):
    rows = [(i, ["a", "b", None][min(i % 10, 2)] if i % 10 < 3 else "hot", 1 + i * 7 % 90, [1.0, 2.0, None, -1.0][i % 4]) for i in range(3000)]
    df = spark.createDataFrame([*rows, (0, "a", 0, 1.0), (7777, "empty", 0, 1.0)], "id bigint, source string, size bigint, weight double")
    found = mixing.mix(df).collect()
    assert len(found) == 3002
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    taken = {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r.size * r.times and 0 <= r.times <= 3 and r.source_size == sizes.get(r.source, 0)
    target = plain_targets(sizes | {"empty": 0})
    assert all(abs(taken[s] - target[s]) <= 90 for s in target)
    again = {(r.id, r.source, r.times) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r.id, r.source, r.times) for r in found}


def test_heavier_rows_are_taken_more_often(spark):
    rows = [(i, "a" if i < 4000 else "b", 10, 4.0 if i % 2 else 1.0) for i in range(8000)]
    found = mixing.mix(spark.createDataFrame(rows, "id bigint, source string, size bigint, weight double")).where("source = 'a'")
    heavy, light = (found.where(F.col("id") % 2 == k).agg(F.sum("times")).first()[0] or 0 for k in (1, 0))
    assert heavy > 1.3 * light


def test_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "id bigint, source string, size bigint, weight double")).count() == 0
