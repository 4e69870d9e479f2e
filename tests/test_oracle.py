"""Every registered query against its DuckDB oracle on the sf0.001 tables,
and the flagship entry point."""


import __spark_entry__ as E
from askbatch.plans.catalog import QUERIES
from tests.oracle_check import run

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["request_id", "question_id", "kind", "pos", "body"]


def test_every_query_has_an_oracle():
    """Optional subpackages may add queries that SQL cannot express; their
    own tests hold those."""
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_all_queries_match_oracle(spark):
    rep = run(SF, list(E.oracle_sql()))
    bad = {k: v for k, v in rep.items() if not v.get("match")}
    assert not bad, bad
