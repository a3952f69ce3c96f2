"""The training-data queries that have SQL give DuckDB's rows."""

from pathlib import Path

import duckdb
import pytest

from geolith.llm import decontaminate, queries


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows_of(con, sql, columns):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    return sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    columns, got = spark_rows(queries.queries()[name](spark, sf_dir))
    assert got == rows_of(con, queries.oracle_sql()[name], columns)


def test_decontamination_of_odd_rows(spark):
    """Null and empty texts, short items, repeated rows and ids, letters other than A-Z, overlapping and repeated items."""
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, f"x {ten.upper()} y"), (1, "É ß ZERO"), (2, None), (3, ""), (4, "É zero, ZERO!"), (4, "É zero, ZERO!"), (5, f"{ten} eleven {ten}"), (None, "zero"), (6, "É-ß"), (7, "é ß")]
    items = [(10, f"{ten} eleven"), (9, ten), (2, "zero"), (3, "É ß"), (4, None), (5, " , "), (2, "zero")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    columns, got = spark_rows(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == rows_of(con, decontaminate.SQL, columns) and sum(r[0] == "True" for r in got) == 7
