import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from souk.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", shuffle_partitions=8, app="souk-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixture_dir(spark):
    import fixture
    return fixture.write(spark, tempfile.mkdtemp(prefix="souk-fixture-"))


@pytest.fixture(scope="session")
def empty_dir(spark):
    import fixture
    return fixture.write(spark, tempfile.mkdtemp(prefix="souk-empty-"), empty=True)


@pytest.fixture(scope="session")
def tables(spark, fixture_dir):
    from souk.sources.tables import load_tables
    return load_tables(spark, fixture_dir)
