import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from bourseflow.session import build_session

    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def prices(spark):
    """Two symbols with a few days each, as the price operators expect them."""
    from datetime import date, timedelta

    rows = []
    for symbol, closes in {"1": [10.0, 12.0, 11.0, 11.0, 15.0, 14.0, 16.0], "2": [5.0, 4.0, 8.0]}.items():
        for i, y in enumerate(closes):
            rows.append((symbol, date(2024, 1, 29) + timedelta(days=i), y, y + 1, y - 1, 100.0 * (i + 1)))
    return spark.createDataFrame(
        rows, "symbol string, ds date, y double, high_price double, low_price double, volume double"
    )
