import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA


@pytest.fixture(scope="session")
def compare():
    """Rows of a Spark query and of its DuckDB twin over one folder of tables."""
    import duckdb

    def rows(frame, columns):
        null = lambda v: v is None or v != v
        plain = lambda v: v.item() if hasattr(v, "item") else v
        return sorted(repr([None if str(v) == "<NA>" or null(v) else plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())

    def run(spark, sf_dir, query, sql):
        connection = duckdb.connect()
        for path in sorted(Path(sf_dir).glob("*.parquet")):
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
        expected = connection.execute(sql).fetchdf()
        found = query(spark, sf_dir).toPandas()
        columns = sorted(expected.columns)
        assert sorted(found.columns) == columns
        return rows(found, columns), rows(expected, columns)

    return run
