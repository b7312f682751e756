import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
for name in ("corpus_pipeline", "tallygrid.llm"):
    sys.modules[name] = None
import __spark_entry__ as e
assert e.queries() and e.queries().keys() == e.oracle_sql().keys()
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""


def test_library_works_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=60)
