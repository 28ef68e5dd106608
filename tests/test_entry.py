"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and "consensus" in queries


def test_nothing_outside_imports_the_subpackage():
    code = "import sys; sys.modules['strandflow.llm'] = None; import __spark_entry__ as e; assert 'consensus' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
