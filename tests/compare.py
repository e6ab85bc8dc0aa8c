"""A query's rows against those of its SQL in DuckDB, column by column, in any order of rows."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone='UTC'")
        for p in Path(sf_dir).glob("*.parquet"):
            where = f"{p}/*.parquet" if p.is_dir() else str(p)
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
        cursor = con.execute(sql)
        return [d[0] for d in cursor.description], cursor.fetchall()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return str(value) if not isinstance(value, float) else value


def by_name(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(normal(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, expected = oracle_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    got = by_name(df.columns, df.collect())
    want = by_name(names, expected)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:5]
