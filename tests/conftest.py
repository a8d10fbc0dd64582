import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitalspan.session import literal_frame, local_session  # noqa: E402

DATA = os.environ.get("VITALSPAN_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g")


@pytest.fixture(scope="session")
def frame(spark):
    """Small frame from rows and a DDL string."""
    return lambda rows, schema: literal_frame(spark, rows, schema)


@pytest.fixture(scope="session")
def cdm(spark):
    from vitalspan.sources.derived import derived_cdm

    return derived_cdm(spark, DATA)
