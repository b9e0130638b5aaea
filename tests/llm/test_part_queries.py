"""Parts of operators against SQL, where the whole operator has none."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import compare, connect  # noqa: E402
from skillgrid.llm.oracles import PART_ORACLES  # noqa: E402
from skillgrid.llm.queries import PART_QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(PART_QUERIES))
def test_part_matches_sql(spark, name):
    assert name in PART_ORACLES
    assert compare(spark, connect(FOLDER), FOLDER, name) is None
