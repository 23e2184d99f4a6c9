"""Rows of a query against rows of its DuckDB SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return shown(con.execute(sql).df())


def shown(pdf) -> tuple[list[str], list[str]]:
    pdf = pdf[sorted(pdf.columns)]
    clean = pdf.astype(object).where(pdf.notna(), None)
    return list(pdf.columns), sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)) for row in clean.itertuples(index=False, name=None))


def assert_same(df, sf_dir: str, sql: str) -> None:
    columns, rows = shown(df.toPandas())
    wanted_columns, wanted = sql_rows(sf_dir, sql)
    assert columns == wanted_columns
    assert rows == wanted
