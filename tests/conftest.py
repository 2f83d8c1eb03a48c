import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from testsieve.session import get_session, checkpoint_dir
    s = get_session("local[*]", 8, app_name="testsieve-tests")
    checkpoint_dir(s)
    yield s


def corpus(spark, files, project="p"):
    """DataFrame ``(project, path, content)`` from ``{path: content}``."""
    rows = [(project, p, c) for p, c in files.items()]
    return spark.createDataFrame(rows, "project string, path string, content string")
