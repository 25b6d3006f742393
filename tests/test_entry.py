"""The registered queries can be read before a session exists."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_registered_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100, (len(q), set(o) - set(q))"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
