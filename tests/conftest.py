import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from lintlake.session import build_session

    session = build_session("tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """``files_of({path: text}, repo=...)`` as a table of files."""

    def build(*repos, **one):
        rows = []
        for repo, contents in list(repos) + list(one.items()):
            for path, content in contents.items():
                name = path.rsplit("/", 1)[-1]
                ext = "." + name.rsplit(".", 1)[1] if "." in name[1:] else ""
                rows.append((repo, path, ext, content))
        return spark.createDataFrame(rows, "repo string, path string, ext string, content string")

    return build
