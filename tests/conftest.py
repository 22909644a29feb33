import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("marginalia-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """sf -> a DuckDB connection with that scale's tables as views."""
    import duckdb

    made = {}

    def at(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for p in Path(DATA, sf).glob("*.parquet"):
                made[sf].execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        return made[sf]

    return at


@pytest.fixture(scope="session")
def same():
    """Order-free comparison of a Spark frame with an oracle's rows."""

    def check(df, con, sql):
        import pandas as pd

        ours, theirs = df.toPandas(), con.execute(sql).fetchdf()
        cols = sorted(ours.columns)
        assert cols == sorted(theirs.columns)
        plain = lambda x: sorted(repr([None if pd.isna(v) else (round(v, 6) if isinstance(v, float) else v) for v in r]) for r in x[cols].astype(object).values.tolist())
        import re

        numbers = lambda rows: [re.sub(r"(\d+)\.0\b", r"\1", r) for r in rows]
        assert numbers(plain(ours)) == numbers(plain(theirs))

    return check
