"""Spark result against the DuckDB result of the same query."""

import glob
import math
import os

import duckdb


def open_tables(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


_DUCK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def duck_type(spark_type):
    return _DUCK_TYPES.get(spark_type, spark_type.upper())


def _sortable(row):
    return [(v is None, str(type(v)), repr(v)) for v in row]


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def differences(df, con, sql):
    """A description of the first difference, or None."""
    cursor = con.execute(sql)
    expected_columns = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    columns = sorted(expected_columns)
    if sorted(df.columns) != columns:
        return f"columns {sorted(df.columns)} instead of {columns}"
    types = {c: duck_type(t) for c, t in df.dtypes}
    relation_types = {
        r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()
    }
    wrong = {c: (types[c], relation_types[c]) for c in columns if types[c] != relation_types[c].replace(", ", ",")}
    if wrong:
        return f"types {wrong}"
    order = list(expected_columns)
    wanted = sorted(([r[order.index(c)] for c in columns] for r in expected), key=_sortable)
    found = sorted(([r[c] for c in columns] for r in df.collect()), key=_sortable)
    if len(wanted) != len(found):
        return f"{len(found)} rows instead of {len(wanted)}"
    for a, b in zip(found, wanted):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"row {a} instead of {b}"
    return None
