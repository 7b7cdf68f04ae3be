"""Worked examples with hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from foldwright.functions import derived as D
from foldwright.functions import semantics as S
from foldwright.operators import encoders as E
from foldwright.operators import ensemble, eventlog, impute, judgment, metrics, missingness, neighbors
from foldwright.plans import plan as P
from foldwright.sources import io

near = lambda x: pytest.approx(x, abs=1e-9)


def test_numeric_rules(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (2.675,), (1.005,), (2.9,), (None,)], "x double")
    r = [tuple(x) for x in df.select(S.round_even("x"), S.round_even("x", 2), S.floor_mod(F.lit(-1.5), 1), S.at_least("x", 3.0)).collect()]
    assert [x[0] for x in r] == [2.0, -2.0, 0.0, 3.0, 1.0, 3.0, None] and r[2][1] == 0.12 and r[0][2] == 0.5
    assert [x[3] for x in r] == [3.0, 3.0, 3.0, 3.0, 3.0, 3.0, None]


def test_identity_digits(spark):
    df = spark.createDataFrame([(3.0,), (2.5,), (1.37,), (None,), (2.9,), (0.25,)], "v double")
    r = df.select(*[c.alias(k) for k, c in D.identity_digits("v").items()]).collect()
    assert (r[2].v_round0, r[2].v_round1, r[2].v_tenths, r[2].v_hundredths) == (1.0, 1.4, 3, 7)
    assert r[2].v_absdiff0 == near(0.37) and r[2].v_absdiff1 == near(0.03) and r[2].v_absdiff2 == near(0)
    assert [(x.v_is_round0, x.v_is_round1) for x in r] == [(1, 1), (0, 1), (0, 0), (None, None), (0, 1), (0, 0)]
    assert r[4].v_tenths == 9 and r[5].v_hundredths == 5 and all(x is None for x in r[3])


def te_frame(spark):
    rows = [(i, "a" if i < 4 else "b", int(i < 4), i % 2, True) for i in range(8)] + [(8, "a", 0, 0, False), (9, "b", 0, 0, False), (10, "u", 0, 0, False)]
    return spark.createDataFrame(rows, "id long, v string, y int, inner int, fit boolean")


def test_target_encoding(spark):
    got = {r.id: (r.te, r.ct) for r in E.target_encode(te_frame(spark), {"v": F.col("v")}, "y", F.col("fit"), "inner", 2.0).collect()}
    assert got[8] == (near(5 / 6), 4) and got[9] == (near(1 / 6), 4) and got[10] == (near(0.5), 0)
    assert got[0] == (near(3 / 4), 2) and got[7] == (near(1 / 4), 2)
    for bad in (-1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            E.target_encode(te_frame(spark), {"v": F.col("v")}, "y", F.col("fit"), "inner", bad)


def test_held_out_labels_do_not_leak(spark):
    df = te_frame(spark)
    flipped = df.withColumn("y", F.when(F.col("fit"), F.col("y")).otherwise(1 - F.col("y")))
    a, b = (sorted(map(tuple, E.target_encode(d, {"v": F.col("v")}, "y", F.col("fit"), "inner", 2.0).collect())) for d in (df, flipped))
    assert a == b


def test_prior_statistics(spark):
    p = spark.createDataFrame([(20, 1), (20, 1), (20, 1), (20, 0), (30, 0), (30, 0)], "age int, y int")
    got = {r.key: r for r in E.prior_stats(p, "age", "y", 2.0).collect()}
    assert got["20"].mean == near(2 / 3) and got["20"].woe == near(math.log(2)) and got["20"]["count"] == near(math.log1p(4))
    assert got["30"].mean == near(1 / 4) and got["30"].woe == near(math.log(1 / 3))


def test_knn(spark):
    ref = spark.createDataFrame([(0, 0.0, 1), (1, 10.0, 1), (2, 20.0, 0), (3, 30.0, 0)], "id long, age double, y int")
    q = spark.createDataFrame([(1, 1.0), (2, 29.0), (3, None)], "id long, age double")
    one = spark.range(1).select(F.lit(1.0).alias("age"))
    assert {r.id: r.nn3 for r in neighbors.knn_mean(ref, q, ["age"], one, "y", 3).collect()} == {1: near(2 / 3), 2: near(1 / 3), 3: None}
    assert {r.id: r.nn1 for r in neighbors.knn_mean(ref, q, ["age"], one, "y", 1).collect()} == {1: 1.0, 2: 0.0, 3: None}


def test_class_cdf_difference(spark):
    ref = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (2.0, 1), (4.0, 1)], "x double, y int")
    q = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, 3.0), (3, 5.0), (4, None), (5, 1.0)], "id long, x double")
    got = {r.id: r.cdf_diff for r in metrics.class_ecdf_difference(ref, q, "x", "y", ["id"]).collect()}
    assert got == {0: near(0), 1: near(1 / 6), 2: near(1 / 2), 3: near(0), 4: None, 5: near(1 / 3)}


def test_ranks_and_auc(spark):
    r = spark.createDataFrame([(0, 1.0, "g"), (1, 1.0, "g"), (2, 3.0, "g")], "id long, v double, g string")
    assert [x.half for x in metrics.half_step_rank(r, "v", ["g"]).orderBy("id").collect()] == [near(1 / 3), near(1 / 3), near(5 / 6)]
    d = spark.createDataFrame([(0, 1.0, 2, "g"), (1, 1.0, 1, "g"), (2, 0.0, 0, "g")], "id long, v double, t int, g string")
    assert [x["rank"] for x in metrics.deterministic_rank(d, "v", "t", ["g"]).orderBy("id").collect()] == [near(5 / 6), near(1 / 2), near(1 / 6)]
    s = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.7, 1), (0.7, 0), (0.9, 1)], "pred double, y int")
    assert metrics.auc(s, "pred", "y").head().auc == near(11 / 12)
    assert metrics.auc(s.where("y = 1"), "pred", "y").head().auc is None


def test_weighted_auc_equals_expanded_rows(spark):
    rows = [(0.1, 0, 2), (0.4, 1, 3), (0.4, 0, 1), (0.8, 1, 2), (0.3, 0, 0)]
    w = spark.createDataFrame(rows, "pred double, y int, w int")
    x = spark.createDataFrame([(p, y) for p, y, k in rows for _ in range(k)], "pred double, y int")
    assert metrics.auc(w, "pred", "y", weight=F.col("w").cast("double")).head().auc == near(metrics.auc(x, "pred", "y").head().auc)


def test_burden_mean_is_one_minus_auc(spark):
    s = spark.createDataFrame([(i, (i * 7 % 10) / 10, i % 2) for i in range(30)], "id long, pred double, y int")
    b = metrics.rank_burden(s, "pred", "y", ["id", "y"]).groupBy("y").agg(F.avg("burden").alias("b")).collect()
    a = metrics.auc(s, "pred", "y").head().auc
    assert all(r.b == near(1 - a) for r in b)


def test_missingness_reweighting(spark):
    x = lambda p: (None if p == "x" or p == "d" else 1.0, None if p == "y" or p == "d" else 1.0)
    train = spark.createDataFrame([(i, *x(p)) for i, p in enumerate(["-"] * 4 + ["x"] * 2 + ["y"] * 2)], "id long, x double, y double")
    test = spark.createDataFrame([(i, *x(p)) for i, p in enumerate(["-"] * 2 + ["x"] * 4 + ["d"] * 2)], "id long, x double, y double")
    w = missingness.row_weights(train, test, ["x", "y"])
    assert {r.id: r.weight for r in w.collect()} == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5, 4: 2.0, 5: 2.0, 6: 0.0, 7: 0.0}
    assert w.agg(metrics.kish("weight")).head()[0] == near(4.0)
    t = {r.names: r for r in missingness.pattern_weights(train, test, ["x", "y"]).collect()}
    assert t["-"].train_rows == 4 and t["x"].weight == 2.0 and t["y"].weight == 0.0 and t["x,y"].weight is None


def test_constrained_clip(spark):
    rows = [(0, 8.0, 2.0, 1.0, 3.0), (1, None, 3.0, 2.0, 1.5), (2, 6.0, None, 1.0, 4.5), (3, 6.0, None, None, 2.0), (4, None, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, daily double, social double, gaming double, work double")
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("id")]
    est = {"daily": F.lit(5.0), "social": pick({0: 0.0, 1: 0.0, 2: 3.0, 3: 9.0, 4: -1.0}), "gaming": pick({0: 0.0, 1: 0.0, 2: 0.0, 3: 5.0, 4: 0.0}), "work": F.lit(0.0)}
    got = {r.id: r for r in impute.constrained_clip(df, est, "daily", ("social", "gaming", "work")).collect()}
    assert got[1].daily_fill == 6.5 and got[2].social_fill == 0.5 and got[4].social_fill == 0.0
    assert (got[3].social_fill, got[3].gaming_fill) == (4.0, 4.0)
    assert [got[i].social_width for i in (0, 2, 3, 4)] == [None, 0.5, 4.0, None] and got[0].social_fill == 2.0


def test_combiners(spark):
    rows = [(i, i % 2, i % 2, m, p) for i in range(60) for m, p in (("strong", 0.1 + 0.8 * (i % 2)), ("weak", 0.4 + 0.2 * (i % 2)), ("inverse", 0.9 - 0.8 * (i % 2)))]
    m = spark.createDataFrame([(i, i // 30, y, n, p) for i, _, y, n, p in rows], "id long, fold int, y int, member string, pred double")
    w = {(r.outer, r.member): r.weight for r in ensemble.performance_weights(m, 2).collect()}
    assert [w[0, k] for k in ("strong", "weak", "inverse")] == [0.5, 0.5, 0.0]
    none = ensemble.performance_weights(m.where("member = 'inverse'"), 2).collect()
    assert all(r.weight == 1.0 for r in none)
    assert ensemble.greedy_select(m, ["inverse", "weak", "strong"]) == ["weak"]


def test_judgments(spark):
    oof = spark.createDataFrame([("a", 0.9700, 0.967), ("b", 0.96701, 0.967), ("c", 0.97, 0.967), ("d2", 0.96715, 0.967), ("d3", 0.96715, 0.967)], "run string, auc double, base double")
    seeds = spark.createDataFrame([(r, s, 0.968 if r != "c" or s == 0 else 0.966, 0.967) for r in ("a", "b", "c", "d2", "d3") for s in range(3)], "run string, seed int, auc double, base double")
    wins = {"a": 2, "b": 5, "c": 5, "d2": 2, "d3": 3}
    folds = spark.createDataFrame([(r, f, 0.968 if f < k else 0.966, 0.967) for r, k in wins.items() for f in range(5)], "run string, fold int, auc double, base double")
    got = {r.run: (r.passed, r.boundary) for r in judgment.confirmation(oof, seeds, folds).collect()}
    assert got == {"a": (True, False), "b": (False, False), "c": (False, False), "d2": (False, True), "d3": (True, True)}
    s = spark.createDataFrame([(n, f, v) for n, vs in {"a": [0.9, 0.9, 0.8, 0.7, 0.7], "b": [0.8, 0.8, 0.9, 0.7, 0.6]}.items() for f, v in enumerate(vs)], "strategy string, fold int, auc double")
    assert {r.strategy: r.wins for r in judgment.fold_wins(s).collect()} == {"a": 3, "b": 1}
    e = {r.strategy: (r.eligible, r.recommended) for r in judgment.ensemble_choice(spark.createDataFrame([("x", 0.96901), ("y", 0.96905)], "strategy string, auc double"), 0.969).collect()}
    assert e == {"x": (False, False), "y": (True, True)}


def test_placebo_gate(spark):
    def gate(canary, placebo, new=()):
        rows = [("canary", canary)] * (canary is not None) + [("placebo", placebo)] * (placebo is not None) + list(new)
        g = spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, mean_gain double")
        feats = spark.createDataFrame([(f,) for f in ("n1", "n2")], "feature string")
        return {r.feature: r.passed for r in judgment.placebo_gate(g, spark.createDataFrame([("canary",)], "feature string"), feats).collect()}

    assert [gate(c, p)["canary"] for c, p in ((100, 100), (500, 100), (0, -1), (0.1, -1), (None, 5), (1, None))] == [True, False, True, False, True, False]
    got = gate(None, 100, [("n1", 400), ("n2", 100)])
    assert got["n1"] and not got["n2"]


def test_event_intervals(spark):
    p = spark.createDataFrame([("s", 1, 0, 100)], "k string, id long, start long, end long")
    c = spark.createDataFrame([("s", 10, 30), ("s", 30, 30), ("s", 25, 28), ("s", 200, 300)], "k string, start long, end long")
    assert eventlog.unclassified(p, c, ["k"]).head().unclassified == 80
    assert eventlog.covered(c, "start", "end", ["k"]).head().covered == 120


def test_plan_rules(spark):
    with pytest.raises(ValueError):
        P.FeaturePlan([P.TargetEncoding(of=["v"], placebo=False)])
    with pytest.raises(ValueError):
        P.FeaturePlan([P.Derived(names=["sgw_sum"]), P.Derived(names=["sgw_sum"])])
    with pytest.raises(ValueError):
        D.derive(spark.range(1), ["no_such_column"])
    plan = P.FeaturePlan([P.TargetEncoding(of=["v"]), P.Derived(names=["sgw_sum"])])
    assert [x[0] for x in plan.describe()] == ["row", "fold"]


def test_sources(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    assert [r.pred for r in io.read_spec(spark, f"{tmp_path}/a.npy[:, 1]").orderBy("pos").collect()] == [1.0, 3.0, 5.0]
    io.write_events(str(tmp_path / "e.json.gz"), [{"record_type": "metadata", "schema_version": 1}, {"record_type": "odd", "schema_version": 2}, {"record_type": "timing", "schema_version": 1, "start_ns": 1}])
    assert tuple(io.event_faults(io.read_events(spark, str(tmp_path / "e.json.gz"))).head()) == (1, 1, 1)
    (tmp_path / "l.json").write_text('[{"name": "c", "seeds": [1, 2], "evidence": {"oof": 0.5, "seed_aucs": {"1": 0.4}}}]')
    assert io.read_ledger(spark, str(tmp_path / "l.json")).head().evidence.seed_aucs == {"1": 0.4}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("hello")
    io.export_bundle(str(tmp_path / "b"), str(tmp_path / "b.zip"))
    io.import_bundle(str(tmp_path / "b.zip"), str(tmp_path / "c"))
    assert (tmp_path / "c" / "x.txt").read_text() == "hello"
