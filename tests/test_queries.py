"""Every query of the reference's operators against its oracle, and that those without one run."""

import pytest
from oracle import same

from lattis.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
