import pytest

from echolens.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", 8, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
