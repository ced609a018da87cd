import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{k}_found" for k in (1, 2, 4, 5, 6)} <= set(entry.queries())


def test_core_stands_without_the_subpackage():
    """Blocks the subpackage and reads the catalogue again."""
    code = "import sys; sys.modules['lumenmesh.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")
def test_flagship_query(spark):
    assert {r["con_type"] for r in entry.entry(spark).collect()} == {"short", "long"}
