import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True).stdout.strip()


def test_queries_are_read_without_a_session():
    assert _run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(set(s) <= set(q) and len(q) > 60)") == "True"


def test_the_core_is_there_without_the_subpackage():
    hidden = "import sys; sys.modules['glossa.llm'] = None; import __spark_entry__ as e; q = e.queries(); print('p5_found' in q and 'p1_found' not in q, set(e.oracle_sql()) <= set(q))"
    assert _run(hidden) == "True True"
