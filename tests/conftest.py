"""One small session for all tests."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    work = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.local.dir", work).config("spark.checkpoint.dir", f"{work}/shared").config("spark.sql.warehouse.dir", f"{work}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
