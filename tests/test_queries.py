"""Every query against its SQL twin, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from shelfloom.plans import registry

D = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return int(v)
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str)) else str(v)


def rows(df, columns):
    return sorted(([plain(v) for v in r] for r in df[columns].astype(object).values.tolist()), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, D).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_and_contract(spark):
    import __spark_entry__ as E

    assert set(registry.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() == 5


def test_entry_without_the_text_operators(tmp_path):
    """The rest imports and has its queries where the text operators are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/shelfloom", tmp_path / "shelfloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as E; q = E.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    # so it is where they are there but a library that they need isn't
    missing = "import sys; sys.modules['public_tokenizers'] = None; " + code
    subprocess.run([sys.executable, "-W", "ignore", "-c", missing], cwd=root, check=True)


@pytest.mark.parametrize("name", ["vector_first_and_best_hit", "ivf_threshold_hits", "vector_category", "blacklist_anti_join"])
def test_more_rows_than_one_block(spark, duck, name, monkeypatch):
    """Queries and listed rows beyond what is sent at once are met in blocks."""
    from shelfloom.operators import ivf

    monkeypatch.setattr(ivf, "MOST_ROWS", 70)
    monkeypatch.setattr(ivf, "MOST_QUERIES", 3)
    assert duck.execute("SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0").fetchone()[0] > 3
    test_query(spark, duck, name)
