import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from siltworks.session import build_session

    return build_session("tests", "local[4]", spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
