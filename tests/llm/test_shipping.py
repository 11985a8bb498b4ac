"""Queries run where the workers cannot import the package."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[2]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from finsearch.session import local_session
import __spark_entry__ as entry
spark = local_session(4, app="elsewhere")
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).rdd.map(lambda _: __import__("finsearch")).count()
    raise SystemExit("workers can import the package")
except Exception as e:
    assert "No module named 'finsearch'" in str(e), e
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        rows = query(spark, "/root/testdata/sf0.001").count()
        assert rows > 0, name
        print(name, rows)
"""


def test_all_queries_from_another_folder(tmp_path):
    run = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stdout[-500:] + run.stderr[-3000:]
    assert run.stdout.count("op") >= 13 and "pipeline" in run.stdout
