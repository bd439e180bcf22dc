import pytest

from arbor.llm.queries import ORACLES
from tests.llm.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, name, "/root/testdata/sf0.001") > 0
