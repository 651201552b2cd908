"""Every query with a closed form equals its SQL on whole tables."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry

# The four-column line item key repeats at the smallest size.
NEEDS_UNIQUE_KEY = {"f3_rank_features", "d18_corr_spearman"}
ORACLES = entry.oracle_sql()
CONNECTIONS = {}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01" if name in NEEDS_UNIQUE_KEY else "/root/testdata/sf0.001"
    con = CONNECTIONS.setdefault(sf_dir, connect(sf_dir))
    assert differences(entry.queries()[name](spark, sf_dir), con, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
