"""The driver's contract, and queries against their SQL on the smallest tables."""

import importlib.util
import os
from pathlib import Path

import pytest

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry_module():
    spec = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_names(entry_module):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_flagship(spark, entry_module):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["doc_tokens", "vocabulary", "index_update", "index_remove", "multi_query_topk", "spell_candidates", "overlap_topk", "embedding_cosine_topk", "page_doc_id"])
def test_against_sql(spark, entry_module, name):
    import duckdb

    c = duckdb.connect()
    for f in Path(D).iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}'")
    r = c.execute(entry_module.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    show = lambda rows: sorted(str([(k, row[k]) for k in sorted(row)]) for row in rows)
    assert show(x.asDict() for x in entry_module.queries()[name](spark, D).collect()) == show(dict(zip(cols, x)) for x in r.fetchall())


def test_runs_without_the_subpackage(tmp_path):
    """Also if an empty folder of its name is left behind."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    for left in (False, True):
        if left:
            (tmp_path / "textloom/llm/__pycache__").mkdir(parents=True)
        code = "import __spark_entry__ as e; assert e._core.__file__.startswith(%r); q = e.queries(); assert len(q) > 50 and not any(k.startswith('p1_') for k in q) and set(e.oracle_sql()) <= set(q)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code % str(tmp_path)], cwd=tmp_path, env=env, check=True, timeout=120)
