"""The library stands without its optional subpackage, and nothing else imports that."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_point_knows_the_optional_part():
    for path in (ROOT / "cladeworks").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "cladeworks").parts:
            assert not re.search(r"cladeworks\.llm|corpus_pipeline", path.read_text()), path


def test_entry_point_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT / "cladeworks", tmp_path / "cladeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pair_distances_hist' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_other_tests_run_without_the_optional_part(tmp_path):
    """All tests but the optional part's can be collected, and a few of each kind pass, where both folders are gone."""
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=gone)
    run = [sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"]
    # the environment stays as it is, but for the folders that hold the whole repository
    paths = [x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != ROOT]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(paths)}
    subprocess.run([*run, "--collect-only"], cwd=tmp_path / "repo", check=True, timeout=120, env=env, stdout=subprocess.DEVNULL)
    few = "entry or taxonomy_nodes or gates or cleaning_chain or only_the_entry_point"
    subprocess.run([*run, "-k", few], cwd=tmp_path / "repo", check=True, timeout=300, env=env)


@pytest.mark.skipif(not (ROOT / "cladeworks" / "llm").exists(), reason="the optional part is gone")
def test_errors_inside_the_optional_part_are_raised(tmp_path):
    shutil.copytree(ROOT / "cladeworks", tmp_path / "cladeworks", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    broken = tmp_path / "cladeworks" / "llm" / "pii.py"
    broken.write_text("import a_module_that_is_not_there\n" + broken.read_text().replace("from __future__ import annotations", ""))
    code = "import __spark_entry__ as e; e.queries()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=120, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "a_module_that_is_not_there" in done.stderr
