"""Structure scans and drift diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwright.functions.semantics import stable
from foldwright.operators import diagnostics as D
from foldwright.sources.tables import F0_SQL, base_frame, members, table

from . import query
from .metric import R

COLS = ["daily", "social", "gaming", "work"]
_K = lambda c: f"coalesce(CAST({c} AS VARCHAR),'__nan__')"
_FD = ["p_brand", "p_type", "p_size"]


@query("diag_dependency_scan", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_K(a)} AS key, {_K(b)} AS value FROM part" for a in _FD for b in _FD if a != b) + "), k AS (SELECT a, b, key, count(*) n, count(DISTINCT value) v FROM l GROUP BY 1,2,3 HAVING count(*)>=3) SELECT a, b, count(*) AS keys, CAST(sum((v>1)::INTEGER) AS BIGINT) AS violating, count(*)>=20 AND sum((v>1)::INTEGER)=0 AS exact FROM k GROUP BY 1,2")
def diag_dependency_scan(spark, sf_dir):
    return D.dependency_scan(table(spark, sf_dir, "part"), _FD, 3, 20)


def _grammar():
    from itertools import combinations

    for a, b in combinations(COLS, 2):
        for c in COLS:
            if c not in (a, b):
                for o in "+-":
                    r = f"({c}-({a}{o}{b}))"
                    yield f"SELECT '{c}={a}{o}{b}' AS rule, {R(f'avg((abs({r})<1e-9)::INTEGER)')} AS exact, {R(f'avg((round_even({r}*10,0)=0)::INTEGER)')} AS shown, {R(f'avg(({r}<-1e-9)::INTEGER)')} AS negative FROM f0"


@query("diag_grammar_scan", f"WITH {F0_SQL} " + " UNION ALL ".join(_grammar()))
def diag_grammar_scan(spark, sf_dir):
    g = D.grammar_scan(base_frame(spark, sf_dir), COLS)
    return g.select("rule", *[stable(c).alias(c) for c in ("exact", "shown", "negative")])


@query("diag_boundary_profile", f"WITH {F0_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS n, min({c}) AS lo, max({c}) AS hi, count(DISTINCT {c}) AS nunique, count(*) FILTER ({c}=(SELECT min({c}) FROM f0)) AS at_lo, count(*) FILTER ({c}=(SELECT max({c}) FROM f0)) AS at_hi FROM f0" for c in COLS))
def diag_boundary_profile(spark, sf_dir):
    return D.boundary_profile(base_frame(spark, sf_dir), COLS)


_DEC = "CASE WHEN {0} IS NULL THEN NULL WHEN abs({0}-round_even({0},0))<1e-9 THEN 0 WHEN abs({0}-round_even({0}*10,0)/10)<1e-9 THEN 1 WHEN abs({0}-round_even({0}*100,0)/100)<1e-9 THEN 2 WHEN abs({0}-round_even({0}*1000,0)/1000)<1e-9 THEN 3 ELSE 4 END"


@query("diag_decimal_resolution", f"WITH {F0_SQL} SELECT {_DEC.format('daily')} AS decimals, count(*) AS n FROM f0 GROUP BY 1")
def diag_decimal_resolution(spark, sf_dir):
    return base_frame(spark, sf_dir).groupBy(D.decimal_resolution("daily").alias("decimals")).agg(F.count("*").alias("n"))


@query("diag_budget_residuals", f"WITH {F0_SQL}, d AS (SELECT daily-(social+gaming+work) AS r FROM f0), e AS (SELECT r FROM d WHERE r IS NOT NULL) SELECT count(*) AS n, {R('avg((r<-1e-9)::INTEGER)')} AS violations, {R('avg((abs(r)<1e-9)::INTEGER)')} AS zero_mass, {R('quantile_cont(r,0.01)')} AS q01, {R('quantile_cont(r,0.5)')} AS q50, {R('quantile_cont(r,0.99)')} AS q99 FROM e")
def diag_budget_residuals(spark, sf_dir):
    b = D.budget_residuals(base_frame(spark, sf_dir), "daily", ["social", "gaming", "work"])
    return b.select("n", *[stable(c).alias(c) for c in b.columns if c != "n"])


@query("diag_conditional_ranges", f"WITH {F0_SQL}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, stress, {c} AS v FROM f0" for c in COLS) + "), g AS (SELECT col, stress, min(v) lo, max(v) hi FROM u GROUP BY 1,2) SELECT col, stress, lo, hi, lo>min(lo) OVER p OR hi<max(hi) OVER p AS tighter FROM g WINDOW p AS (PARTITION BY col)")
def diag_conditional_ranges(spark, sf_dir):
    return D.conditional_ranges(base_frame(spark, sf_dir), "stress", COLS)


_COMBOS = ["gender", "age", "weekend"]


def _coverage():
    from itertools import combinations

    for k in (1, 2):
        for combo in combinations(_COMBOS, k):
            on = " AND ".join(f"f0.{c} IS NOT DISTINCT FROM s.{c}" for c in combo)
            yield f"SELECT '{'+'.join(combo)}' AS combo, {R('avg((i IS NOT NULL)::INTEGER)')} AS coverage, {R('avg(y) FILTER (i IS NOT NULL)')} AS rate_in, {R('avg(y) FILTER (i IS NULL)')} AS rate_out FROM (SELECT y, s.i FROM f0 LEFT JOIN (SELECT DISTINCT {', '.join(combo)}, 1 AS i FROM f0 WHERE fold=1) s ON {on} WHERE f0.fold=0)"


@query("diag_combination_coverage", f"WITH {F0_SQL} " + " UNION ALL ".join(_coverage()))
def diag_combination_coverage(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    c = D.combination_coverage(f.where("fold = 0"), f.where("fold = 1"), _COMBOS, "y")
    return c.select("combo", *[stable(x).alias(x) for x in ("coverage", "rate_in", "rate_out")])


@query("diag_binned_rate", f"WITH {F0_SQL}, b AS (SELECT CASE WHEN price<50 THEN 0 WHEN price<100 THEN 1 WHEN price<200 THEN 2 WHEN price<=1000 THEN 3 END AS bin, y FROM f0) SELECT bin, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n, {R('sum(y)/count(*)')} AS rate FROM b WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*)>=10")
def diag_binned_rate(spark, sf_dir):
    b = D.binned_rate(base_frame(spark, sf_dir).where("price >= 0"), "price", [0, 50, 100, 200, 1000], "y", 10)
    return b.select("bin", "pos", "n", stable("rate").alias("rate"))


@query("diag_id_deciles", f"WITH {F0_SQL}, e AS (SELECT " + ", ".join(f"quantile_cont(id,{i / 10}) e{i}" for i in range(1, 10)) + " FROM f0), b AS (SELECT y, " + "+".join(f"(e{i}<id)::INTEGER" for i in range(1, 10)) + f" AS bin FROM f0, e) SELECT bin, count(*) AS n, {R('avg(y)')} AS rate, {R('sqrt(avg(y)*(1-avg(y))/count(*))')} AS se FROM b GROUP BY 1")
def diag_id_deciles(spark, sf_dir):
    d = D.decile_profile(base_frame(spark, sf_dir), "id", "y")
    return d.select("bin", "n", stable("rate").alias("rate"), stable("se").alias("se"))


@query("diag_value_concentration", f"WITH {F0_SQL}, g AS (SELECT social, count(*) n FROM f0 WHERE social IS NOT NULL GROUP BY 1), t AS (SELECT n FROM g ORDER BY n DESC, social LIMIT 20) SELECT {R('(SELECT sum(n) FROM t)/(SELECT sum(n) FROM g)')} AS share")
def diag_value_concentration(spark, sf_dir):
    return D.concentration(base_frame(spark, sf_dir), "social", 20).select(stable("share").alias("share"))


@query("diag_contingency_chi2", f"WITH {F0_SQL}, n AS (SELECT stress, y, count(*) n FROM f0 WHERE stress IS NOT NULL GROUP BY 1,2), a AS (SELECT stress, sum(n) ra FROM n GROUP BY 1), b AS (SELECT y, sum(n) rb FROM n GROUP BY 1), t AS (SELECT sum(n) t FROM n), c AS (SELECT ra*rb/t AS e, coalesce(n.n,0) AS o FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n ON n.stress=a.stress AND n.y=b.y) SELECT {R('sum((o-e)*(o-e)/e)')} AS chi2 FROM c")
def diag_contingency_chi2(spark, sf_dir):
    return D.chi_square(base_frame(spark, sf_dir).where("stress is not null"), "stress", "y").select(stable("chi2").alias("chi2"))


@query("diag_generator_fingerprint", f"WITH {F0_SQL}, a AS (SELECT price AS v, count(*) na FROM f0 WHERE fold<>0 GROUP BY 1), b AS (SELECT price AS v, count(*) nb FROM f0 WHERE fold=0 GROUP BY 1), j AS (SELECT coalesce(na,0) na, coalesce(nb,0) nb FROM a FULL JOIN b USING (v)) SELECT {R('(sum(nb) FILTER (na=0))/sum(nb)')} AS off_grid, {R('(count(*) FILTER (na>0 AND nb>0))/(count(*) FILTER (na>0))')} AS cover, {R('(count(*) FILTER (nb=1))/(count(*) FILTER (nb>0))')} AS singletons FROM j")
def diag_generator_fingerprint(spark, sf_dir):
    f = base_frame(spark, sf_dir)
    g = D.fingerprint(f.where("fold <> 0"), f.where("fold = 0"), "price")
    return g.select(*[stable(c).alias(c) for c in g.columns])


@query("diag_subgroup_difficulty", f"WITH {F0_SQL}, s AS (SELECT *, abs(y-0.5-((id*37)%101)/202.0::DOUBLE) AS burden FROM f0) SELECT condition, CAST(sum(rows) AS BIGINT) AS rows, {R('min(i-o)')} AS least_increase, bool_and(coalesce(rows>=50 AND i-o>=0.01, false)) AS passed FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS condition, fold, sum(({c})::INTEGER) rows, avg(burden) FILTER ({c}) i, avg(burden) FILTER (NOT ({c})) o FROM s GROUP BY fold" for n, c in {"old": "age>=40", "x": "gender='x'", "nosocial": "social IS NULL"}.items()) + ") GROUP BY 1")
def diag_subgroup_difficulty(spark, sf_dir):
    s = base_frame(spark, sf_dir).withColumn("burden", F.abs(F.col("y") - 0.5 - F.pmod(F.col("id") * 37, F.lit(101)) / 202.0))
    d = D.subgroup_difficulty(s, {"old": F.col("age") >= 40, "x": F.col("gender") == "x", "nosocial": F.col("social").isNull()}, "burden", "fold", 50, 0.01)
    return d.select("condition", "rows", stable("least_increase").alias("least_increase"), "passed")


@query("diag_near_duplicate_members")
def diag_near_duplicate_members(spark, sf_dir):
    """Members joined by rank correlation, grouped, the strongest representing."""
    from foldwright.operators import metrics as M
    from foldwright.operators.components import groups

    m = members(base_frame(spark, sf_dir))
    edges = M.spearman_pairs(m, "id", "member", "pred").where("abs(rho) >= 0.9")
    return groups(M.auc(m, "pred", "y", ["member"]).select("member", "auc"), edges).select("member", "representative")
