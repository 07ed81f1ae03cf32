"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences
from conftest import SMALL

import __spark_entry__ as contract
from assaylens.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SMALL)
    assert differences(df, con, ORACLES[name], 1e-9) == []


# the operators whose ordering may be cut into ranges, forced to be
CUT = ["label_quantile", "mann_whitney_lineitem", "bh_fdr", "spearman", "subgroup_sensitivity", "roc_points", "pr_auc", "biomarker_summary"]


@pytest.mark.parametrize("name", CUT)
def test_query_matches_sql_with_cut_groups(spark, con, tiny_groups, name):
    df = contract.queries()[name](spark, SMALL)
    assert differences(df, con, ORACLES[name], 1e-9) == []


def test_entry(spark):
    assert contract.entry(spark).count() == 80
