"""One Spark session for all tests, with its checkpoints in a temporary folder."""

import os
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = os.environ.get("QUADREL_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(folder))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def rows_of(frame):
    """Rows of a pandas frame in any order, columns by name, numbers to six places."""
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or str(v) in ("<NA>", "NaT") or v != v:
                cells.append("null")
            elif hasattr(v, "__float__") and not isinstance(v, (bool, np.bool_)):
                cells.append(f"{float(v) + 0.0:.6f}".replace("-0.000000", "0.000000"))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


@pytest.fixture(scope="session")
def compare(spark, sf_dir):
    """compare(query, sql): the query's rows against DuckDB's."""
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")

    def run(query, sql):
        got, want = query(spark, sf_dir).toPandas(), db.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)

    return run
