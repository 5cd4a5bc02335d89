"""The entry module without the operators for training data, or without a library that they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), sum(n.startswith("op") and "_" in n and n[2].isdigit() for n in names), "pipeline" in names, set(entry.oracle_sql()) <= set(names))
"""


@pytest.mark.parametrize("name", ["wakecross.llm", "corpus_pipeline", "tokenizers"])
def test_other_queries_stay(name):
    done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    count, of_llm, pipeline, paired = done.stdout.split()[-4:]
    assert int(count) > 40 and of_llm == "0" and pipeline == "False" and paired == "True"
