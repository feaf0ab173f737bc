"""One local session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from alertframe.session import get_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    s = get_session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    return s
