import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("emberframe-tests", 8)


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """Rows as a parquet table: like recorded data, its size is known to the plan."""

    def write(rows, schema):
        path = str(tmp_path_factory.mktemp("table") / "rows")
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return write
