import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from siteloom.session import clear_staged, local_session

    # tiny inputs: compiling a plan costs more than interpreting it
    session = local_session(4, "tests", spark__sql__shuffle__partitions="2", spark__default__parallelism="2", spark__sql__codegen__wholeStage="false")
    session.sparkContext.setLogLevel("OFF")
    yield session
    clear_staged(session)
