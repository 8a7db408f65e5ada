import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from nomenlink.session import build_session

    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture()
def apply(spark):
    """Evaluate a column function on literal texts."""
    from pyspark.sql import functions as F

    def run(function, *values, kind="string"):
        arity = len(values[0]) if isinstance(values[0], tuple) else 1
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        schema = ", ".join(f"c{i} {kind}" for i in range(arity))
        df = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], f"n int, {schema}")
        out = df.select("n", function(*[F.col(f"c{i}") for i in range(arity)]).alias("v")).collect()
        return [row["v"] for row in sorted(out, key=lambda r: r["n"])]

    return run
