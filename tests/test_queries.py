"""Every query against its SQL, on the smallest tables."""

import pytest

from strideway.plans.catalogue import ORACLES, QUERIES
from tests.oracle import differences

#: Kernels that SQL can't tell; their tests are in test_kernels.py.
ROWS_ONLY = {"features_all", "steps_from_windows"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), ORACLES[name], sf) == ""
