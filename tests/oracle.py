"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


# DuckDB's name for each Spark type.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, types, row counts and values agree."""
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema.fields}
    other = [f"{c}: {ours.get(c)} != {t}" for c, t in theirs.items() if ours.get(c) != t]
    if other:
        return ["types differ", *other]
    names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    oracle_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != oracle_names:
        return [f"columns {names} != {oracle_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    bad = [f"{g} != {w}" for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ", *bad[:3]] if bad else []
