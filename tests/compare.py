"""Holds queries against their oracles: columns by name, rows as a multiset of rendered values."""

from __future__ import annotations

import collections
import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def second_engine(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rendered(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], collections.Counter(tuple(rendered(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty where both agree."""
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other = bag([c[0] for c in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} and {other[0]}"
    if mine[1] != other[1]:
        return f"rows {sum(mine[1].values())} and {sum(other[1].values())}; only here {list((mine[1] - other[1]).items())[:3]}; only there {list((other[1] - mine[1]).items())[:3]}"
    return ""
