import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="8g")
    yield session
    session.stop()


@pytest.fixture
def cell(spark):
    """Evaluate one column expression over one row of named text values."""
    def evaluate(column, **values):
        names = list(values) or ["x"]
        row = tuple(values.values()) or (None,)
        schema = ", ".join(
            f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}"
            for n, v in zip(names, row))
        return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]
    return evaluate
