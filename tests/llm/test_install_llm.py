"""Every query of the subpackage runs on workers that do not have the repository on their path."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_workers_need_no_path_to_the_package(tmp_path, root):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from weftwork.session import get_session
spark = get_session("elsewhere", cores="4")
for name, query in sorted(e.queries().items()):
    if name == "pipeline" or name.startswith("op"):
        print(name, query(spark, {root!r}).count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    lines = [line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline"))]
    assert len(lines) == 14 and all(int(n) > 0 for _, n in lines)
