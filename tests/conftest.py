import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import local_session

    s = local_session(4, conf={"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class Compared:
    """Holds a query's rows against its SQL in DuckDB over the same tables."""

    def __init__(self, sf):
        import glob

        import duckdb

        self.con = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            self.con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    @staticmethod
    def plain(v):
        import datetime
        import decimal

        if isinstance(v, float):
            return None if v != v else round(v, 6)
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return v

    def same(self, df, sql):
        from collections import Counter

        got = self.con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        theirs = Counter(tuple(self.plain(r[names.index(c)]) for c in order) for r in got.fetchall())
        ours = Counter(tuple(self.plain(r[c]) for c in order) for r in df.collect())
        assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])


@pytest.fixture(scope="session")
def compared(sf):
    return Compared(sf)
