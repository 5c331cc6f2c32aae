"""The entry module without the optional subpackage: all other queries stay."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


@pytest.mark.parametrize("keep", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_optional_folders(tmp_path, keep):
    shutil.copytree(ROOT / "trajspark", tmp_path / "trajspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *keep]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names, sql = (set(line.split()) for line in done.stdout.splitlines()[-2:])
    assert names == {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} and len(names) > 100
    assert sql == {n for n in entry.oracle_sql() if n in names}
