import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlake.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """Rows (path, content) of one repository ``r`` as a files table."""
    def build(*rows, repo="r"):
        data = [(repo, "main", "c", f"{repo}/{p}", c) for p, c in rows]
        return spark.createDataFrame(
            data, "repo_path string, branch string, commit_hash string, path string, content string")
    return build
