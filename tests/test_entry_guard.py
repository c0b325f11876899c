"""The entry works where the training-data subpackage cannot be imported."""

import subprocess
import sys


def test_engine_queries_stay_without_a_dependency():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q) and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True).returncode == 0
