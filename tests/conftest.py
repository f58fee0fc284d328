import os

import pytest

from tessella.session import get_session

DATA = os.environ.get("TESSELLA_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__default__parallelism="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def base():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test data at {DATA}")
    return DATA
