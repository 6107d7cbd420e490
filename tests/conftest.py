import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexforge.session import local_session

    s = local_session(cores=4, partitions=4, memory="3g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
