"""The driver contract, with and without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def registered(folder):
    import json

    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return map(set, json.loads(out.stdout.splitlines()[-1]))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copytree(f"{ROOT}/codelore", tmp_path / "codelore", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    from codelore.plans import registry

    queries, oracles = registered(tmp_path)
    core, sql = registry.collect(registry.MODULES)
    assert queries == set(core) and oracles == set(sql)


def test_entry_has_every_core_query():
    from codelore.plans import registry

    queries, oracles = registered(ROOT)
    core, sql = registry.collect(registry.MODULES)
    assert queries >= set(core) and oracles >= set(sql) and oracles <= queries


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
