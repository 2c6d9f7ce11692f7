"""Every query with an oracle, at the smallest scale."""

import pytest

from lexispan.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(name, spark, sf_dir, same):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
