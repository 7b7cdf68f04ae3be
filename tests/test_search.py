"""Subset searches and bagging against plain loops."""

from pyspark.sql import functions as F

from foldwright.operators import search as S
from foldwright.operators.ensemble import greedy_select
from foldwright.sources.tables import base_frame, members

SF = "/root/testdata/sf0.001"
NAMES = ["m1", "m2", "m3", "m4", "m5"]


def test_subset_search_beyond_its_trials():
    """More subsets than trials: never worse than greedy and all members."""
    names = [f"n{i}" for i in range(10)]
    calls = []

    def score(subsets):
        calls.extend(map(tuple, subsets))
        return [1 - abs(sum(int(n[1]) for n in s) - 17) / 100 for s in subsets]

    got = S.subset_search(score, names, trials=40)
    tried = dict(zip(calls, score(list(calls))))
    assert tried[tuple(got)] == max(tried.values()) >= score([names])[0]
    assert tuple(names) in tried and len(set(calls)) < 200
    assert got == S.subset_search(score, names, trials=40)


def test_greedy_stops_and_breaks_ties():
    assert S.greedy(lambda subsets: [0.5 for _ in subsets], ["b", "a"]) == ["b"]
    assert S.greedy(lambda subsets: [float(len(s)) for s in subsets], ["b", "a"]) == ["b", "a"]


def test_bags_are_class_halves_and_weights_are_means(spark):
    f = base_frame(spark, SF)
    long = members(f).where("member in ('m1', 'm3', 'm4')").cache()
    names = ["m1", "m3", "m4"]
    bags = S.class_halves(f, 3).cache()
    sizes = {(r.bag, r.y): r["count"] for r in bags.join(f, "id").groupBy("bag", "y").count().collect()}
    classes = {r.y: r["count"] for r in f.groupBy("y").count().collect()}
    assert all(abs(sizes[b, y] - n / 2) <= 0.5 for b in range(3) for y, n in classes.items())
    assert bags.where("bag = 0").join(bags.where("bag = 1").select("id"), "id").count() not in (0, sizes[0, 0] + sizes[0, 1])
    want = dict.fromkeys(names, 0.0)
    for b in range(3):
        got = greedy_select(long.join(bags.where(F.col("bag") == b).select("id"), "id"), names)
        for n in got:
            want[n] += 1 / len(got) / 3
    weights = S.bagged_greedy(long, names, bags=3)
    assert all(abs(weights[n] - want[n]) < 1e-12 for n in names)
