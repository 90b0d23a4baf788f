"""The entry module imports wherever pyspark itself imports, also from a zip."""

import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_with_zipped_pyspark():
    zips = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "*.zip")))
    code = ("import pyspark, __spark_entry__ as e; assert '.zip' in pyspark.__file__, pyspark.__file__; "
            "assert len(e.queries()) > 70 and len(e.oracle_sql()) > 60")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*zips, ROOT])}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
