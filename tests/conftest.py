import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sitegraph.session import build_session

    session = build_session("tests", 8, **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def page(spark):
    """Pages from markup texts, numbered from 0."""
    def make(*markup):
        rows = [(i, f"http://site.example/p{i}", m) for i, m in enumerate(markup)]
        return spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")

    return make
