import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thematrail.session import local_session  # noqa: E402

MENTIONS = "row_id bigint, entity string, grp string, category string, mentions bigint, summary string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4, name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mentions(spark):
    """Builds a mentions table from (entity, grp, category, mentions[, summary]) rows, numbered in order."""

    def build(rows):
        full = [(i, *row, *([None] * (5 - 1 - len(row)))) for i, row in enumerate(rows)]
        return spark.createDataFrame([r if len(r) == 6 else (*r, None) for r in full], MENTIONS)

    return build


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="session")
def plan():
    return plan_of
