"""Every registered query against its SQL on the smallest tables; the rest must at least yield rows."""

import pytest

import __spark_entry__ as entry
from compare import differences, types
from compare import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
SLOW = ("N15_", "X12_", "N12_")  # trained in test_models instead


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert differences(df, con, ORACLE[name]) + types(df, con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and not n.startswith(SLOW)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["location", "n_posts", "total_engagement", "engagement_rank"] and df.count() == 25
