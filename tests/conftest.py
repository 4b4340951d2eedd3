import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lumenspark.session import session

    made = session(cores=8, shuffle_partitions=8)
    made.sparkContext.setLogLevel("ERROR")
    return made
