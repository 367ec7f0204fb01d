"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def oracle_connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}" if value else "0"
    if value is None:
        return "null"
    if isinstance(value, (int, bool)):
        return f"{float(value):.9g}" if value else "0"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None when both agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            count = sum(x != y for x, y in zip(ours, theirs))
            return f"{count} of {len(ours)} rows, first {a} / {b}"
    return None
