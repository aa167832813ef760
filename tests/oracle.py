"""Runs a query's SQL in DuckDB on the tables of a folder, and compares rows whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    value = lambda x: "null" if x is None or str(x) in ("<NA>", "NaT", "nan") else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    made = query(spark, sf)
    found, wanted = made.toPandas(), con.sql(sql).df()
    for name, kind in made.dtypes:  # pandas makes floats of integers beside nulls
        if kind in ("int", "bigint") and found[name].dtype.kind == "f" and str(wanted[name].dtype)[0] == "I":
            found[name] = found[name].astype("Int64")
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
