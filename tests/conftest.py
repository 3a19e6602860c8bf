"""One local session for all tests; scratch folders are new for each run."""

from __future__ import annotations

import glob
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = subprocess.run(["mktemp", "-d", "/tmp/spark-XXXXXX"], capture_output=True, text=True, check=True).stdout.strip()
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": scratch, "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.checkpoint.dir": f"{scratch}/shared", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def lines(df) -> list[str]:
    """Rows as sorted text, columns by name, numbers to seven digits."""
    import math

    import pandas as pd

    def one(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.6g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")

    df = df[sorted(df.columns)]
    return sorted("|".join(map(one, r)) for r in df.itertuples(index=False))
