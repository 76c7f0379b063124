"""Comparison with DuckDB."""

SF = "/root/testdata/sf0.001"


def duck(sql: str, sf: str = SF):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.sql(sql)
    return sorted(r.columns), sorted(tuple(norm(x[r.columns.index(k)]) for k in sorted(r.columns)) for x in r.fetchall())


def norm(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def same(df, sql: str, sf: str = SF) -> None:
    cols, rows = duck(sql, sf)
    assert sorted(df.columns) == cols
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == rows
