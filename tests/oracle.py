"""Compare a query with its SQL."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def told(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6f}"
    return str(v)


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.execute(sql).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    x, y = (d[columns].map(told).sort_values(columns).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(x, y, check_dtype=False)
    return len(a)
