from __future__ import annotations

import os
import sys

import pytest
from hypothesis import settings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelmill.runtime import session  # noqa: E402


# The same examples each time.
settings.register_profile("repeatable", derandomize=True)
settings.load_profile("repeatable")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    made.sparkContext.setLogLevel("ERROR")
    if not made.sparkContext.getCheckpointDir():
        made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return made


def same_rows(left, right) -> bool:
    """Equal as bags of rows, columns matched by name."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a = sorted(map(repr, (tuple(r) for r in left.select(*columns).collect())))
    b = sorted(map(repr, (tuple(r) for r in right.select(*columns).collect())))
    return a == b
