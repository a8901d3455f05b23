import re

import pytest

from tessera.llm import registry

from ..oracle import agree

SF = "/root/testdata/sf0.001"


def test_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    agree(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
