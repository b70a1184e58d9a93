import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from postmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests", 4, 4, checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
        sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column helper on literal inputs."""
    def run(kind, inputs, fn):
        from pyspark.sql import functions as F
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        rows = frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
        return [r.o for r in rows]
    return run
