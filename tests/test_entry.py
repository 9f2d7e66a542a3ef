"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "Longitudinal_From_Special" in df.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """What the driver does: the llm folders and the pipeline are gone, the entry still imports and serves its own queries."""
    for name in ("__spark_entry__.py",):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "pathloom"), tmp_path / "pathloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'traj_full' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 100


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "pathloom")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "pathloom.llm" not in f.read(), name
