import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from lodeseek.session import local_session

    small = {"spark.default.parallelism": "2", "spark.sql.shuffle.partitions": "4"}
    return local_session("tests", cores="8", **small)
