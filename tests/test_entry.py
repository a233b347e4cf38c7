"""The driver's contract, and that the rest of the library stands without the text operators."""

import pathlib
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent
DATA = pathlib.Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def own():
    from stratagrid.plans.all_queries import QUERIES

    return sorted(QUERIES)


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", own())
def test_query_equals_its_sql(spark, name):
    rows = entry.queries()[name](spark, str(DATA))
    got = sorted((tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect()), key=str)
    if name not in entry.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(rows.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_nothing_imports_the_text_operators():
    for path in ROOT.glob("stratagrid/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_stands_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT / "stratagrid", tmp_path / "stratagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    n, m, pipeline = said.stdout.split()[-3:]
    assert int(n) >= 60 and int(m) >= 60 and pipeline == "False"
