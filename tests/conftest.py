import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("CODEGRID_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from codegrid.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="codegrid-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from codegrid.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF
