from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    session = local_session(4, memory="4g", app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


SF = "/root/testdata/sf0.001"


def oracle_rows(sql: str, folder: str = SF):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.execute(sql).fetch_df()


def same_rows(a, b) -> bool:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    plain = lambda x: x[columns].astype(object).where(x[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)
    return plain(a).equals(plain(b))
