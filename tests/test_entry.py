from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_imports_without_the_optional_part(tmp_path):
    optional = {"llm", ".git", "__pycache__", ".pytest_cache"}
    shutil.copytree(ROOT, tmp_path / "repo", ignore=lambda folder, names: optional & set(names))
    code = "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q == 'pipeline' or q.startswith('op')])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    count, *names = said.stdout.split(" ", 1)
    assert int(count) > 90 and names[0].strip() == "[]"
