"""Runs a query and its SQL on the same tables and compares names, rows and values without order."""

import math
from pathlib import Path

import duckdb
import numpy as np

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or isinstance(value, (bool, str, bytes)):
        return value
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    number = float(value)
    return "nan" if math.isnan(number) else float(np.float32(number)) if isinstance(value, np.float32) else number


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def assert_same(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = query(spark, sf_dir)
    expected = con.sql(sql)
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(expected.columns, expected.fetchall())
