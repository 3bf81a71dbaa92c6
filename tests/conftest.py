import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "logsieve-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")),
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


REQUEST = (
    "row_id long, ip string, event_s long, method string, path string, status int, size long, referer string, "
    "user_agent string, source string"
)


@pytest.fixture
def requests(spark):
    """Build requests from dicts; fields left out get harmless values."""

    def make(*rows):
        base = {
            "ip": "10.0.0.1", "event_s": 0, "method": "GET", "path": "/", "status": 200, "size": 0, "referer": "-",
            "user_agent": "Mozilla/5.0", "source": "www",
        }
        filled = [{**base, "row_id": i, **row} for i, row in enumerate(rows)]
        names = [part.split()[0] for part in REQUEST.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], REQUEST)

    return make
