import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and {r["rank"] for r in rows} == set(range(1, 11))
