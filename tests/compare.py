"""Rows of a query against those of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb


def database(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*names).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    out = con.execute(sql)
    columns = [c[0] for c in out.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(r[i] for i in order) for r in out.fetchall())
