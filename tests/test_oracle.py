"""Every query that has an SQL equivalent, against DuckDB."""

import pytest

from foldwright import queries as Q
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
Q.load()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    compare(Q.QUERIES[name](spark, SF), Q.ORACLES[name], con)


@pytest.mark.parametrize("name", ["missing_count_tv_distance", "comb_greedy_rank_mean", "comb_ridge_logit_nested", "comb_nnls_logit_nested", "judge_pool_entry", "comb_missing_4plus", "comb_strategy_table", "comb_c_selected_shrunk", "plan_fold_fit", "prep_rank_gauss", "impute_distribution_sample", "split_control_trials", "stream_liveness_state", "model_chained_imputation", "diag_near_duplicate_members"])
def test_other_queries_give_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0


def test_combiners_score_every_row(spark):
    """Nested combiners score all folds and bands; the sums taken apart by fold give the
    fits of five separate passes."""
    from foldwright.operators import ensemble as E
    from foldwright.queries.ensembles import NAMES
    from foldwright.sources.tables import base_frame, members

    f = base_frame(spark, SF)
    m = members(f)
    for name in ("comb_missing_segmented",):
        assert Q.QUERIES[name](spark, SF).count() == f.count()
    want = {}
    for k in range(5):
        b, w = E.ridge(E.moments(m.where(f"fold <> {k}"), NAMES).head(), NAMES, 1.0)
        want.update({r.id: r.pred for r in E.linear_scores(m.where(f"fold = {k}"), w, b).collect()})
    got = {r.id: r.pred for r in Q.QUERIES["comb_ridge_logit_nested"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in want)
