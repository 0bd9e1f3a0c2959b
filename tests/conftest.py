import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewash.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", app="tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """A one-column table with a row number ``k``, and a way to read the column back in order."""
    def make(values, kind="double"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"k bigint, c {kind}")
    return make


def read(df, name="c"):
    return [r[name] for r in df.orderBy("k").collect()]
