"""Operators on Python workers that cannot import the package."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from codeloom.session import local_session
from codeloom.llm import queries
spark = local_session(2, 2, **{{"spark.checkpoint.dir": {shared!r}}})
def importable(batches):
    import importlib.util
    yield from (b.assign(id=int(importlib.util.find_spec("codeloom") is not None)) for b in batches)
assert spark.range(1).mapInPandas(importable, "id long").first()[0] == 0
for name in {names!r}:
    assert queries.QUERIES[name](spark, {folder!r}).count() > 0
"""


@pytest.mark.parametrize("names", [["op4_repeated_strings"], ["op5_repeated_paragraphs"], ["op12_spelling_variants", "op13_merkle_manifest"]])
def test_without_the_package(tmp_path, folder, names):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, shared=str(tmp_path / "shared"), names=names, folder=folder))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
