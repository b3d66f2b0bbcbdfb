"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    if key in ORACLES:
        assert compare(df, con, ORACLES[key]) is None
    else:
        assert df.columns and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["source ip", "n_flows"]


def test_core_queries_do_without_a_library_of_the_text_part(monkeypatch):
    import sys
    core = {k for k in QUERIES if not k.startswith("op") and k != "pipeline"}
    for name in [x for x in sys.modules if x.startswith("flowspark.llm") or x == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    # None makes the import fail as if the library were not there
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert set(entry.queries()) == core and set(entry.oracle_sql()) <= core
