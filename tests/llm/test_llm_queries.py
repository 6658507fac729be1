"""Registered queries against their SQL, and the entry without this folder."""

import pytest

from compare import agree, connect

from codelattice.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    agree(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name])


def test_all_ten_and_the_pipeline_are_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in known) for i in range(1, 11)) and "pipeline" in known
