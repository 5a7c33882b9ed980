import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query's rows with its SQL's, as multisets, columns by name."""
    import datetime
    import decimal
    from collections import Counter

    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def plain(x):
        if isinstance(x, decimal.Decimal):
            return int(x) if x == x.to_integral_value() else float(x)
        if isinstance(x, float):
            return round(x, 9)
        if isinstance(x, datetime.datetime) and x.tzinfo:
            return x.astimezone(datetime.UTC).replace(tzinfo=None)
        return x

    def run(query, sql, sf_dir):
        con = duckdb.connect()
        for n in names:
            con.execute(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")
        out = con.execute(sql)
        columns = [d[0] for d in out.description]
        want = [tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True), key=lambda x: x[0])) for r in out.fetchall()]
        df = query(spark, sf_dir)
        assert sorted(df.columns) == sorted(columns)
        got = [tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()]
        a, b = Counter(got), Counter(want)
        assert a == b, (len(got), len(want), list((a - b).items())[:3], list((b - a).items())[:3])

    return run
