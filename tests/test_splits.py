"""Folds and splits."""

import random

import pytest
from pyspark.sql import functions as F

from varigrade.operators import folds


def greedy(sizes, k):
    loads, taken = [0] * k, [0] * k
    for size in sorted(sizes, reverse=True):
        fold = loads.index(min(loads))
        loads[fold] += size
        taken[fold] += 1
    return loads, taken


@pytest.mark.parametrize("seed", range(40))
def test_levels_equal_one_by_one_greedy(seed):
    draw = random.Random(seed)
    k = draw.randint(2, 6)
    sizes = [draw.choice([1, 1, 1, 2, 3, 5, draw.randint(1, 60)]) for _ in range(draw.randint(1, 120))]
    if seed % 3 == 0:
        sizes.append(sum(sizes) // 2 + 1)
    histogram = [(s, sizes.count(s)) for s in set(sizes)]
    loads, taken = [0] * k, [0] * k
    for size, first, last, fold in folds.level_loads(histogram, k):
        loads[fold] += size * (last - first)
        taken[fold] += last - first
    assert (loads, taken) == greedy(sizes, k)


def test_groups_stay_together_and_loads_balance(spark):
    rows = [("hot",)] * 400 + [(f"g{i % 150}",) for i in range(800)] + [(None,)] * 7
    df = spark.createDataFrame(rows, "g string")
    split = folds.group_kfold(df, "g", 5, missing="none")
    assert split.count() == len(rows)
    assert split.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = {}
    for (g,) in rows:
        sizes[g] = sizes.get(g, 0) + 1
    assert sorted(r["count"] for r in split.groupBy("fold").count().collect()) == sorted(greedy(sizes.values(), 5)[0])


def test_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "g string")
    assert {r.g: r.fold for r in folds.group_kfold(df, "g", 5).collect()} == {"b": 0, "a": 1}


def test_random_split_is_stable_and_complete(spark):
    df = spark.range(20000)
    train, test = folds.random_split(df, "id")
    assert train.count() + test.count() == 20000
    assert 3700 < test.count() < 4300
    again = folds.random_split(df.repartition(13), "id")[1]
    assert test.exceptAll(again).count() == 0 and again.exceptAll(test).count() == 0
    assert folds.random_split(df, "id", seed=1)[1].exceptAll(test).count() > 0


def test_unseen_groups(spark):
    df = spark.createDataFrame([(0, f"m{i % 15:02d}") for i in range(60)] + [(1, "x")], "fold int, mutation string")
    rows = {r.fold: r for r in folds.fold_unseen_groups(df, "mutation").collect()}
    assert rows[0].n_unseen == 15 and rows[0]["sample"] == [f"m{i:02d}" for i in range(10)]
    assert rows[1]["sample"] == ["x"]
