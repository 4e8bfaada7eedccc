import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="module")
def docs(spark):
    from fixtures import frame

    return frame(spark).cache()


@pytest.fixture
def empty(spark):
    from fixtures import frame

    return frame(spark, [])
