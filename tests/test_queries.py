"""Every registered query against its SQL; the others for their rows' shape."""

from __future__ import annotations

import pytest

from strandloom.plans.queries import ORACLE_SQL, QUERIES

from .conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, ORACLE_SQL[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"ctg1", "end1", "ctg2", "end2", "w"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_link_matrix_is_symmetric(spark):
    links = QUERIES["contact_matrix"](spark, DATA)
    there = {(r["ctg1"], r["end1"], r["ctg2"], r["end2"]): r["n"] for r in links.collect()}
    assert there and all(there[c, d, a, b] == n for (a, b, c, d), n in there.items())
