"""Compare a registered query with its SQL on the same parquet tables, by sorted rows of columns in name order."""

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return db


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(sf_dir, sql):
    found = connection(sf_dir).execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def differences(df, sf_dir, sql):
    """None if both agree, else a short account."""
    (a, x), (b, y) = spark_rows(df), sql_rows(sf_dir, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        only_x, only_y = [r for r in x if r not in set(y)][:2], [r for r in y if r not in set(x)][:2]
        return f"{len(x)} and {len(y)} rows; only here {only_x}; only in SQL {only_y}"
    return None
