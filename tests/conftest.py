import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "scripts"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cellselect.session import local_session
    return local_session("8", 8)


@pytest.fixture(scope="session")
def tables(spark):
    from cellselect.plans.fixtures import Tables
    return Tables(spark, SMALL)
