"""The package works wherever PySpark and the repository lie."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

REPO = Path(__file__).resolve().parents[1]


def run(code: str, cwd: Path, timeout: int = 300, **env) -> str:
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=clean, capture_output=True, text=True, timeout=timeout)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_import_with_pyspark_from_a_zip_and_without_a_jvm(tmp_path):
    lib = next(p / "python" / "lib" for p in Path(pyspark.__file__).resolve().parents if (p / "python" / "lib").is_dir())
    zips = [str(lib / "pyspark.zip"), *map(str, lib.glob("py4j-*.zip"))]
    code = (
        "import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__; q = e.queries(); assert set(e.oracle_sql()) <= set(q);"
        "from pyspark import SparkContext; assert SparkContext._gateway is None; print(len(q))"
    )
    assert int(run(code, tmp_path, PYTHONPATH=os.pathsep.join([*zips, str(REPO)]))) > 200


def test_workers_need_no_path_to_the_package(tmp_path, root):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
from weftwork.session import get_session
spark = get_session("elsewhere", cores="4")
for name in ("k06_knn", "k17_text_oof", "k24_dbscan_all_columns", "k23_ward", "k03_poly_svm", "k05_linear_hinge_l1", "j01_one_hot_vector"):
    print(name, e.queries()[name](spark, {root!r}).count())
"""
    assert all(int(line.split()[1]) > 0 for line in run(code, tmp_path, timeout=900).splitlines()[-7:])
