import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagesim.session import configure, ship
    from pagesim.sources import register

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield register(ship(configure(session)))
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
