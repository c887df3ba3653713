"""The entry offers the other queries whatever happens to the training-data ones."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("blocked, warned", [("palimpsest.llm", False), ("palimpsest.llm.queries", False), ("xxhash", True), ("zstandard", True)])
def test_missing_modules(blocked, warned):
    code = f"""
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r}:
            raise ModuleNotFoundError("none", name=name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
names = set(e.queries())
assert "pdf_reports" in names and "strip_xml" in names and not any(n.startswith("op1_") for n in names) and "pipeline" not in names and set(e.oracle_sql()) <= names
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    there = (ROOT / "palimpsest" / "llm" / "queries.py").exists()
    assert done.returncode == 0, done.stderr
    assert ("not offered" in done.stderr) == (warned and there)
