import os
import sys
from pathlib import Path

import pytest

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from textmill.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("4", "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def save(spark, tmp_path):
    """Writes rows as a parquet table of a fixture folder and returns the folder."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put
