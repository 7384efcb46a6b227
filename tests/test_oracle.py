"""Every query with SQL against DuckDB on the small tables; every other one has to run."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from quillspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in registry.ORACLES:
        assert columns
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted([tuple(_plain(r[i]) for i in at) for r in rel.fetchall()], key=str)


def _copy_without(tmp_path, *gone):
    """A copy of the repository without some of its files and folders."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    skip = {root / g for g in gone}
    shutil.copytree(root, tmp_path / "repo", ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or Path(d) / n in skip])
    return tmp_path / "repo"


def _python(folder, *arguments):
    """Run Python in the folder with this process's environment, less what leads to this repository; its output is shown where it fails."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and root not in (Path(p).resolve(), *Path(p).resolve().parents)]
    done = subprocess.run([sys.executable, *arguments], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(path)})
    assert done.returncode == 0, f"{done.stdout[-4000:]}\n{done.stderr[-4000:]}"
    return done.stdout


def test_entry_imports_without_optional_modules(tmp_path):
    """The entry module works where corpus_pipeline and the llm folders are gone, and the other tests can be collected."""
    folder = _copy_without(tmp_path, "corpus_pipeline.py", "quillspan/llm", "tests/llm")
    _python(folder, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and 'pipeline' not in e.queries()")
    assert "error" not in _python(folder, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider").lower().splitlines()[-1]


def test_llm_queries_stay_without_the_pipeline_and_others_without_their_modules(tmp_path):
    import importlib.util

    if importlib.util.find_spec("quillspan.llm") is None:
        pytest.skip("the llm folder is gone")
    folder = _copy_without(tmp_path, "corpus_pipeline.py")
    _python(folder, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'op6_ngram_jaccard' in q and 'pipeline' not in q")
    blocked = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert 'star_revenue' in q and 'op6_ngram_jaccard' not in q"
    _python(folder, "-c", blocked)
