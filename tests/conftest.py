import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from roughcut.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    from roughcut.session import drop_scratch
    drop_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sales(spark):
    from roughcut.sources.tables import sales_with_hash
    return sales_with_hash(spark, SF01)
