"""Aggregates given as functions, with states that merge across tasks and are handed out early."""

import random
from collections import defaultdict

import pytest

from turnstile.operators.userfold import UserAggregate, fold_by

# A state that SQL has no aggregate for: the three dearest sales, as text.
DEAREST = UserAggregate(init=list, add=lambda s, price, name: sorted([*s, (price, name)], reverse=True)[:3],
                        merge=lambda a, b: sorted(a + b, reverse=True)[:3], finish=lambda s: " ".join(name for _, name in s))


@pytest.mark.parametrize("held", [1, 100_000])
def test_user_functions(spark, held):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, *"abc"]), rng.random(), f"n{i}") for i in range(600)]
    groups = defaultdict(list)
    for key, price, name in rows:
        groups[key].append((price, name))
    frame = spark.createDataFrame(rows, "key string, price double, name string").repartition(6)
    got = {r.key: r.value for r in fold_by(frame, "key", ["price", "name"], DEAREST, "string", held).collect()}
    assert got == {k: " ".join(n for _, n in sorted(v, reverse=True)[:3]) for k, v in groups.items()}
    assert fold_by(frame.limit(0), "key", ["price", "name"], DEAREST, "string", held).count() == 0


def test_a_hot_key_costs_a_row_a_task(spark):
    frame = spark.range(0, 5000, 1, 4).selectExpr("'hot' as key", "id")
    merges = spark.sparkContext.accumulator(0)

    def merge(a, b):
        merges.add(1)
        return a + b

    got = fold_by(frame, "key", ["id"], UserAggregate(lambda: 0, lambda s, x: s + x, merge), "long").collect()
    assert [(r.key, r.value) for r in got] == [("hot", 5000 * 4999 // 2)] and merges.value == 3
