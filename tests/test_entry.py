"""The driver's entry with and without the training-data folder."""

import subprocess
import sys

from tests.conftest import ROOT

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "escalade.llm" or name.startswith("escalade.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 120 and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_training_data_operators():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
