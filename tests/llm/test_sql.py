"""Registered queries of this package against their SQL statements, over whole tables."""

import pytest

from gateflow.llm.queries import QUERIES, SQL
from tests.oracle import differences, duck


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert differences(QUERIES[name](spark, folder).toPandas(), duck(folder).execute(SQL[name]).df()) == ""
