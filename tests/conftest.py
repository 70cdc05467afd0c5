import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from samewise.session import session

    return session(4, **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": "/tmp/samewise-warehouse"})
