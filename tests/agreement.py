"""Compares a Spark result with the SQL twin's, as unordered rows by column name."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from decimal import Decimal

import duckdb

SF_DIR = os.environ.get("GATE_SF_DIR", "/root/testdata/sf0.01")


def database(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "DATE": "date",
    "BOOLEAN": "boolean",
}


def difference(df, con, sql: str) -> str | None:
    relation = con.sql(sql)
    theirs_columns, theirs = relation.columns, relation.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(theirs_columns):
        return f"columns {sorted(df.columns)} != {sorted(theirs_columns)}"
    theirs_types = dict(zip(theirs_columns, map(str, relation.types), strict=True))
    for name, kind in df.dtypes:
        their = theirs_types[name]
        their = KINDS.get(their, their.lower())
        if kind != their:
            return f"type of {name}: {kind} != {their}"
    a, b = rows(df.columns, ours), rows(theirs_columns, theirs)
    if a == b:
        return None
    left, right = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows vs {len(b)}; only spark {left}; only sql {right}"
