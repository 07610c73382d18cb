from __future__ import annotations

import os
import signal
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


#: Seconds that one test may take.
MOST_SECONDS = 600


@pytest.fixture(autouse=True)
def time_limit():
    """A test that never ends fails, and those after it run."""

    def stop(*_):
        raise TimeoutError(f"a test took over {MOST_SECONDS} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(MOST_SECONDS)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
