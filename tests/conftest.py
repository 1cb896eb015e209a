import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import get_session
    s = get_session("local[*]", 8, app="sluice-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def one_body_records(spark, body, root="$.data", connector="c1"):
    from sluice.operators import extract as X
    pages = spark.createDataFrame([(connector, 1, 0, "page", 200, 1, body, False, len(body), None, {})],
                                  "connector_id string, run_id bigint, page_idx int, kind string, status int, "
                                  "duration_ms bigint, body string, truncated boolean, body_length bigint, "
                                  "error string, headers map<string,string>")
    return X.extract_records(pages, root)
