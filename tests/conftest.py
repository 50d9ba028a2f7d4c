import os
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from notelake.session import local_session

    s = local_session("8", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def folder(tmp_path):
    """Writes tables (name -> pyarrow table) as an input folder."""

    def write(**tables: pa.Table) -> str:
        for name, t in tables.items():
            pq.write_table(t, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write
