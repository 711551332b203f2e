"""Every registered query of the fleet runs on the smallest tables and, where SQL can say it, gives the rows of DuckDB."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from fleetcut.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return round(float(v), 7) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["h16_without_fillers", "j27_filler_spans", "j28_trim_candidates", "j29_filler_candidates"])
def test_fillers_have_rows(spark, name):
    """Their results are compared on small tables in test_text.py."""
    assert registry.queries()[name](spark, SF).count() > 0


def test_the_rest_works_without_training_data_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports and has every query of the fleet and no other."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e; from fleetcut.plans import registry as r; assert set(e.queries()) == set(r.queries()) and set(e.oracle_sql()) == set(r.oracle_sql()); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(registry.queries()), out.stderr


def test_entry_holds_the_fleet():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
