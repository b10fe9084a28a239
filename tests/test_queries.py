"""Every registered core query against its SQL, on whole small tables."""

import subprocess
import sys
from pathlib import Path

import pytest
from helpers import rows_of

from blockmill.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, tables, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got) > 0 or name in ()
    if name in ORACLES:
        assert rows_of(got) == rows_of(tables.sql(ORACLES[name]).df())


def test_core_stands_without_the_llm_package():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['blockmill.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for path in (root / "blockmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "blockmill.llm" not in path.read_text()
