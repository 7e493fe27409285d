import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from treegauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


FILES = "project string, file_path string, content string"


@pytest.fixture
def tree(spark):
    """Builds a files table from {path: content}."""

    def build(files: dict, project: str = "p"):
        return spark.createDataFrame([(project, k, v) for k, v in files.items()], FILES)

    return build
