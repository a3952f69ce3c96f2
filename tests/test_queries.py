"""Every registered query with SQL gives DuckDB's rows; llm queries are tested in tests/llm."""

from pathlib import Path

import duckdb
import pytest

from geolith.plans import queries as own


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def text(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = own.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    if name not in own.SQL:
        assert got
        return
    rel = duck.execute(own.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry_module_works_without_the_llm_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['geolith.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport importlib\n" \
           "real = importlib.import_module\n" \
           "def fake(name, *a):\n    if name.startswith(('geolith.llm', 'corpus_pipeline')):\n        raise ModuleNotFoundError(name, name=name)\n    return real(name, *a)\n" \
           "importlib.import_module = fake\nimport __spark_entry__ as e\nassert 'geoparse_documents' in e.queries() and not any(k.startswith('op') for k in e.queries()), e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
