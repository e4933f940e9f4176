import math
import os
import tempfile

import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def normal(rows):
    """Rows as sorted tuples; numbers rounded to nine significant digits, so that sums in another order agree."""

    def one(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if hasattr(x, "as_integer_ratio"):
            x = float(x)
            return "nan" if math.isnan(x) else f"{x:.9g}" if x else "0"
        return str(x)

    return sorted(tuple(one(x) for x in r) for r in rows)


@pytest.fixture(scope="session")
def duck():
    def run(sf_dir, sql):
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(sf_dir):
            c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
        r = c.sql(sql)
        names = sorted(r.columns)
        rows = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
        return names, normal([x[n] for n in names] for x in rows)

    return run


@pytest.fixture(scope="session")
def spark_rows():
    def run(df):
        names = sorted(df.columns)
        return names, normal(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())

    return run
