"""Compare a query with its SQL: columns by name, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), _rows(columns, cur.fetchall())


_FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text", "boolean": "bool",
}


def type_differences(con, df, sql):
    """Columns whose kind (integer, float, text, boolean) differs between both sides."""
    spark_types = {c: _FAMILY.get(t, t) for c, t in df.dtypes}
    sql_types = {r[0]: _FAMILY.get(r[1].lower(), r[1].lower()) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (t, sql_types.get(c)) for c, t in spark_types.items() if sql_types.get(c) != t}
