import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sentiloom.session import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                            spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from sentiloom.session import clear_scratch

    clear_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from sentiloom.sources.fixtures import Views

    return Views(spark, SMALL)
