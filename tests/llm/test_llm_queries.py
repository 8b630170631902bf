"""Registered queries of the subpackage against their DuckDB text, and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from compare import compare, duck
from conftest import ROOT, SMALL

from cellselect.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert compare(spark, duck(SMALL), name, QUERIES[name], ORACLES[name], SMALL).startswith("ok")


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES} == {*(f"op{n}" for n in range(1, 14)), "pipeline"}


def test_the_rest_imports_without_the_subpackage(tmp_path):
    for part in ("cellselect", "__spark_entry__.py"):
        source = Path(ROOT, part)
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "cellselect" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 170
