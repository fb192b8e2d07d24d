"""Run a query and its SQL on the same tables and compare the rows."""

import datetime
import math
import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(
                f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{sf_dir}/{file}')"
            )
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr
    )


# Type names of the two engines that mean the same.
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, con, sql: str) -> list[str]:
    """Empty if columns, types and rows agree."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    types = dict(zip(names, [str(d[1]) for d in found.description]))
    want_names, want = _rows(names, found.fetchall())
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if got_names != want_names:
        return [f"columns {got_names} / {want_names}"]
    for name, kind in df.dtypes:
        if SAME_TYPE.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} / {types[name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    return out
