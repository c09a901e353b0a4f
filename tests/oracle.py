"""Compares a registered query with its DuckDB oracle on the driver's tables."""

import glob
import os

import duckdb
import pandas

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{SF}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pandas.NA or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=lambda r: tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * (1 + abs(b))
    return a == b


def check(spark, build, sql):
    columns, found = rows_of(build(spark, SF).toPandas())
    wanted_columns, wanted = rows_of(connect().execute(sql).df())
    assert columns == wanted_columns
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert all(map(close, a, b)), (a, b)
