"""The driver's comparison, in short: columns by name, rows in any order, values by text."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def rows_of(table):
    table = table.select(sorted(table.column_names))
    return table.column_names, sorted(tuple(str(v) for v in r.values()) for r in table.to_pylist())


def same(spark, con, query, sql, sf_dir):
    got = rows_of(query(spark, sf_dir).toArrow())
    want = rows_of(con.execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1], [x for x in zip(got[1], want[1], strict=True) if x[0] != x[1]][:3]
