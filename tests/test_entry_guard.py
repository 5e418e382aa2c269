"""The entry point without the training-data operators, or without a module that they need."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

ASK = """
import sys, warnings
for name in sys.argv[1:]:
    sys.modules[name] = None
with warnings.catch_warnings(record=True) as told:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
    from vitrine.plans import registry
    names = set(entry.queries())
    sql = set(entry.oracle_sql())
assert set(registry.QUERIES) <= names and set(registry.ORACLE) <= sql
print(len(names - set(registry.QUERIES)), len(sql - set(registry.ORACLE)), any("left out" in str(w.message) for w in told))
"""


def ask(folder, *blocked):
    out = subprocess.run([sys.executable, "-c", ASK, *blocked], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("module", ["ahocorasick", "xxhash"])
def test_a_module_that_cannot_be_imported_costs_its_queries_alone(module):
    if not os.path.isdir(f"{ROOT}/vitrine/llm"):
        pytest.skip("the package is not there")
    assert ask(ROOT, module) == ["0", "0", "True"]


def test_a_copy_without_the_package(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/vitrine", tmp_path / "vitrine", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert ask(tmp_path) == ["0", "0", "False"]
