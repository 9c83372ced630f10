"""The rest works without the removable parts."""

import os
import shutil
import subprocess
import sys

import pytest

from tables import ROOT

COUNT = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


def counted(root, path):
    # the copy is read, also where the caller's search path names the original
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=root, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


@pytest.mark.parametrize("gone", [["plumbline/llm", "tests/llm"], ["plumbline/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], ["plumbline/llm/__init__.py"]])
def test_queries_without(tmp_path, gone):
    import plumbline.more_queries  # noqa: F401
    import plumbline.run_queries  # noqa: F401
    from plumbline.queries import QUERIES

    root = tmp_path / "repo"
    root.mkdir()
    for part in ("plumbline", "tests", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, root / part)
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, root / part)
    for part in gone:
        if (root / part).is_dir():
            shutil.rmtree(root / part)
        elif (root / part).exists():
            (root / part).unlink()
    for path in ({}, {"PYTHONPATH": str(ROOT)}):
        every, removable = counted(root, path)
        assert every - removable == len(QUERIES)
        assert removable == (13 if (root / "plumbline/llm/__init__.py").exists() else 0)
