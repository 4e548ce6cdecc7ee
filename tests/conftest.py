from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("qaprep-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from qaprep.session import ship_package

    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column function on one text."""
    from pyspark.sql import functions as F

    def value(function, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        schema = ", ".join(f"{n} string" for n in names)
        df = spark.createDataFrame([tuple(texts)], schema)
        return df.select(function(*[F.col(n) for n in names]).alias("v")).first()["v"]

    return value


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
