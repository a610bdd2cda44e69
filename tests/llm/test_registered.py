import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_are_readable_without_a_session():
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None; "
            "assert 'pipeline' in q and all(any(n.startswith(f'op{i}_') for n in q) for i in range(1, 14)); assert set(s) <= set(q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
