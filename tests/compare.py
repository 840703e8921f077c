"""Spark results against DuckDB."""
import numbers
import os

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def views(sf_dir=SF):
    """A DuckDB connection with the driver's tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def same_rows(df, sql, sf_dir=SF):
    """Whether a Spark result and a DuckDB query give the same multiset of rows."""
    ref = views(sf_dir).execute(sql).df()
    cols = sorted(ref.columns)
    assert sorted(df.columns) == cols
    got = df.select(*cols).toPandas()

    def plain(frame):
        out = []
        for row in frame[cols].itertuples(index=False):
            out.append(tuple("~" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, numbers.Number) and not isinstance(x, (bool, np.bool_)) else str(x) for x in row))
        return sorted(out)

    a, b = plain(got), plain(ref)
    assert len(a) == len(b)
    assert a == b
