import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from textmart.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Column expressions at module level need a session.
SESSION = local_session(8, "textmart-tests", memory="4g")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SMALL).exists():
        pytest.skip("test tables are not here")
    return SMALL


@pytest.fixture()
def value(spark):
    """Evaluate one expression over one row of columns."""

    def evaluate(expression, schema="t string", *row):
        return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]

    return evaluate
