"""Every query with SQL gives the rows of its SQL."""

import pytest
from oracle import same_rows

from veilframe.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["lang", "entity_type", "n"]
