"""Cases in which a review found a wrong result or an error."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foldwright import queries as Q
from foldwright.functions import semantics as S
from foldwright.operators import metrics, neighbors, neural_prep, packed, resampling, search, stacking
from tests.oracle import TABLES, compare, database

Q.load()
SF = "/root/testdata/sf0.001"


def folder(spark, path, **tables):
    """A copy of SF's folder with some tables replaced by the given rows."""
    for t in TABLES:
        (path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t, df in tables.items():
        at = path / f"{t}.parquet"
        at.unlink()
        pq.write_table(df.toArrow(), at)
    return str(path)


@pytest.mark.parametrize("case", ["all_on_grid", "missing", "no_rows_of_fold", "no_rows"])
def test_fingerprint_equals_sql(spark, tmp_path, case):
    o = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 40")
    price = {"all_on_grid": F.lit(5000.0), "missing": F.expr("case when o_orderkey % 4 > 0 then o_totalprice end")}.get(case)
    keep = {"no_rows_of_fold": "o_orderkey % 5 <> 3", "no_rows": "false"}.get(case, "true")
    o = (o if price is None else o.withColumn("o_totalprice", price)).where(keep)
    d = folder(spark, tmp_path, orders=o)
    compare(Q.QUERIES["diag_generator_fingerprint"](spark, d), Q.ORACLES["diag_generator_fingerprint"], database(d))


def test_uniform_numbers_of_large_keys(spark):
    keys = [0, 5, 149_999, 9_000_000, 1 << 31, 10**12, (1 << 62) + 7]
    rows = spark.createDataFrame([(k,) for k in keys], "id long")
    got = {r.id: r.u for r in rows.select("id", S.uniform("id", 31).alias("u")).collect()}
    assert got == {k: (k * 1103515245 + 31 * 12345) % (1 << 31) / (1 << 31) for k in keys}
    w = resampling.bootstrap_weights(rows, 2).withColumn("u", F.lit(0)).collect()
    assert len(w) == 3 * len(keys) and all(r.w == 1 for r in w if r.replicate == 0)


@pytest.mark.parametrize("shift", [0, 9_000_000, 3_000_000_000])
def test_paired_bootstrap_of_large_ids(spark, shift):
    """Ids that differ by multiples of the modulus draw the same weights; others are whole."""
    rows = spark.range(400).select((F.col("id") + shift).alias("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b"))
    same = rows.withColumn("id", F.col("id") + (1 << 31))
    one, two = (sorted(map(tuple, resampling.paired_bootstrap(r, 3, ["a", "b"]).collect())) for r in (rows, same))
    assert one == two and [r[0] for r in one] == [0, 1, 2, 3] and all(r[1] is not None for r in one)


def test_bootstrap_summary_of_large_ids(spark):
    rows = spark.range(400).select((F.col("id") + 9_000_000).alias("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 37 % 101 / 101.0).alias("a"), (F.col("id") * 53 % 97 / 97.0).alias("b"))
    d = resampling.paired_bootstrap(rows, 8, ["a", "b"])
    s, deltas = resampling.summary(d).head(), sorted(r.delta for r in d.where("replicate > 0").collect())
    assert s["median"] == pytest.approx((deltas[3] + deltas[4]) / 2) and deltas[0] <= s["lo95"] <= s["median"] <= s["hi95"] <= deltas[-1]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_knn_of_many_rows_on_few_points(spark, monkeypatch, k):
    """Rows of one point don't travel more than k times; ties go by id, missing shares nothing."""
    monkeypatch.setattr(neighbors, "REFERENCE_ROWS", 12 * k)
    r = np.random.default_rng(1)
    some = lambda n: [(int(i), None if a == 3 else float(a), None if b == 2 else float(b), int(y)) for i, a, b, y in zip(r.permutation(n), r.integers(0, 4, n), r.integers(0, 3, n), r.integers(0, 2, n))]
    schema = "id long, a double, b double, y int"
    ref, query = some(400), some(60)
    one = spark.createDataFrame([(2.0, 0.5)], "a double, b double")
    got = {x.id: x[1] for x in neighbors.knn_mean(spark.createDataFrame(ref, schema), spark.createDataFrame(query, schema), ["a", "b"], one, "y", k).collect()}
    far = lambda p, q: sum(((u - v) / s) ** 2 for u, v, s in zip(p[1:3], q[1:3], (2.0, 0.5)) if u is not None and v is not None)
    for q in query:
        near = sorted(ref, key=lambda p: (far(p, q), p[0]))[:k]
        assert got[q[0]] == (None if q[1] is None and q[2] is None else pytest.approx(sum(p[3] for p in near) / k))
    assert len(got) == len(query)


def test_rank_gauss_searches_among_quantiles(spark):
    """No lambda runs over the quantiles of each row; ties, ends, missing and no fit rows."""
    from statistics import NormalDist

    fit = [float(v) for v in (1, 2, 2, 2, 3, 5, 8, 8, 13)]
    ask = [None, 0.0, 1.0, 1.5, 2.0, 4.0, 8.0, 13.0, 14.0]
    df = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, x double")
    got = neural_prep.rank_gauss(df(fit), df(ask), "x", 9)
    assert got.columns == ["id", "x", "x_gauss"] and "lambda" not in got._jdf.queryExecution().toString()
    q = sorted(fit)
    for r in got.collect():
        x = ask[r.id]
        if x is None:
            assert r.x_gauss is None
            continue
        at = [i for i, v in enumerate(q) if v == x]
        p = (at[0] + at[-1]) / 2 / 8 if at else float(np.interp(x, q, np.arange(9) / 8))
        assert r.x_gauss == pytest.approx(NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)), abs=1e-6)
    assert [r.x_gauss for r in neural_prep.rank_gauss(df([None]), df(ask), "x").collect()] == [None] * len(ask)


def test_mixing_tables_travel_packed():
    """Sparse counts take under 0.6 of the 64-bit form, of any size; they come back whole."""
    import zlib

    from foldwright.llm import mixing

    r = np.random.default_rng(3)
    for most in (2, 200, 70_000, 1 << 33):
        x = np.zeros(100_000, np.uint64)
        x[r.integers(0, len(x), 30_000)] = r.integers(0, most, 30_000)
        z = mixing._pack(x)
        assert (mixing._unpack(z) == x).all()
        if most < 1000:
            assert len(z) < 0.6 * len(zlib.compress(x.astype("<u8").tobytes(), 1))
    assert (mixing._unpack(mixing._pack(np.zeros(64, np.uint64))) == 0).all()


def test_streams_keep_their_rows_off_the_driver(spark):
    """A stream's result is read from files, not from rows held by the driver."""
    from foldwright.streaming import events

    for build, mode in ((events.sessions, "complete"), (events.liveness, "update")):
        got = events.run_available(spark, SF, build, mode)
        plan = got._jdf.queryExecution().toString()
        assert "FileScan parquet" in plan and "MemoryPlan" not in plan and got.count() > 0
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert events.run_available(spark, SF, events.sessions, "complete").agg(F.sum("n")).head()[0] == n


def test_bagged_greedy_holds_each_row_once(spark, monkeypatch):
    """Bags are bits of a row and not rows; the same choice as where each bag's rows are held."""
    r = np.random.default_rng(7)
    y = r.integers(0, 2, 300)
    rows = [(i, int(y[i]), m, round(float(r.normal(0, 1) + y[i] * k / 3), 1)) for i in range(300) for k, m in enumerate("abc")]
    long = spark.createDataFrame(rows, "id long, y int, member string, pred double").cache()
    values = [np.unique([p for *_, m, p in rows if m == n]) for n in "abc"]
    s = search.BagScores(long, "abc", values, 9, 0)
    assert s.rows.count() == 300
    w = search._WideScores(long, "abc", 9, 0)
    trials = {b: ([b % 3] * (b > 2), [k for k in range(3) if b <= 2 or k != b % 3]) for b in range(9)}
    one, two = s(trials), w(trials)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-12) for k in one)
    got = search.bagged_greedy(long, "abc", 9)
    monkeypatch.setattr(search, "LOOKUP", 9)
    assert got == search.bagged_greedy(long, "abc", 9)


def test_packed_auc(spark, monkeypatch):
    """Parts, ties, counts beyond a byte, negative values and one class."""
    r = np.random.default_rng(2)
    sets = [(r.integers(-(1 << 33), 1 << 33, 500), r.integers(0, 2, 500)), (r.integers(-2, 2, 3000), r.integers(0, 2, 3000)), (np.arange(4), np.ones(4, int))]
    run = lambda _: (b for g, (v, y) in enumerate(sets) for half in (slice(None, None, 2), slice(1, None, 2)) for b in packed.pack(g, v[half], y[half]))
    got = packed.aucs(spark.range(1, numPartitions=1).mapInArrow(run, packed.SCHEMA))
    for g, (v, y) in enumerate(sets[:2]):
        want = metrics.auc(spark.createDataFrame([(int(a), int(b)) for a, b in zip(v, y)], "v long, y int"), "v", "y").head()["auc"]
        assert got[g] == pytest.approx(want, abs=1e-12)
    assert got[2] is None


@pytest.mark.parametrize("lookup", [200_000, 3])
def test_shrunk_aucs_equal_exploded_rows(spark, monkeypatch, lookup):
    """The AUCs of all blends equal those over a row for each scope and lambda."""
    monkeypatch.setattr(stacking, "LOOKUP", lookup)
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 240)
    rows = [(i, i % 3, int(y[i]), m, round(float(np.clip(0.5 + 0.1 * y[i] * k + r.normal(0, 0.15), 0.02, 0.98)), 2)) for i in range(240) for k, m in enumerate("ab")]
    long = spark.createDataFrame(rows, "id long, fold int, y int, member string, pred double").cache()
    p = stacking.prepared(long, ["a", "b"], 3)
    assert ("mids" in p.rows.columns) == (lookup == 3)
    fits = stacking.logistic(p, "rank_logit", [p.without(k) for k in range(3)])
    lams = (0.25, 1.0)
    got = stacking.shrunk_aucs(p, "rank_logit", [[(k, f, fits[f]) for k in range(3) for f in range(3) if f != k]] * 2, lams)
    assert got[0] == got[1] and len(got[0]) == 6
    s = stacking.scores(p, "rank_logit", [(k, p.cells([f]), fits[f]) for k in range(3) for f in range(3) if f != k])
    s = metrics.rank_pct(s.withColumn("pred", F.rint(F.col("pred") * 1e9)), "pred", ["scope", "fold"])
    even = metrics.rank_pct(long, "pred", ["fold", "member"]).groupBy("id").agg(F.avg("pct").alias("even"))
    j = s.join(even, "id").withColumn("lam", F.explode(F.array(*map(F.lit, lams)))).withColumn("pred", F.rint((F.col("lam") * F.col("pct") + (1 - F.col("lam")) * F.col("even")) * 1e9))
    want = {(x["scope"], x["lam"]): x["auc"] for x in metrics.auc(j, "pred", "y", ["scope", "lam"]).collect()}
    assert want.keys() == got[0].keys() and all(got[0][k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_mixing_chunks_are_bounded_by_spelled_bytes():
    """Chunks of spelled words hold fewer tokens; they cover all, cut at blocks of a document."""
    from foldwright.llm import mixing

    r = np.random.default_rng(6)
    sizes = np.array([1, 40_000, 3, 90_000, 0, 500, 7, 30_000]) + 1
    offs, length = np.concatenate([[0], np.cumsum(sizes)]), r.integers(1, 60, sizes.sum())
    stop = np.cumsum(length)
    t = mixing.Tokens(np.zeros(len(length), np.uint64), offs, stop - length, stop)
    spelled = r.random(len(length)) < 0.7
    cost = 1 + np.where(spelled, (length + 1) // 3, 0)
    for limit in (mixing.CHUNK_COST, mixing.TRAIN_COST):
        got = mixing._chunks(t, spelled, limit)
        assert got[0][0] == 0 and got[-1][1] == len(length) and all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert max(cost[a:b].sum() for a, b in got) <= limit and max(b - a for a, b in got) <= mixing.CHUNK_TOKENS
        for a, _ in got:
            d = np.searchsorted(offs, a, "right") - 1
            assert (a - offs[d]) % mixing.BLOCK == 0
