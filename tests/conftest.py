import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.plans.ship import ship
    from brindle.session import local_session

    os.environ.setdefault("BENCH_DRIVER_MEM", "3g")
    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    ship(s)
    yield s
    s.stop()
