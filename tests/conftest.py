import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bidlattice.session import build, prepare  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('shared')}"
    out = build("local[4]", 4, **{"spark.checkpoint.dir": at, "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    out.sparkContext.setLogLevel("ERROR")
    out.sparkContext.setCheckpointDir(at)
    prepare(out)
    yield out
    out.stop()
