"""Task functions must load where the package is not installed."""

import pickle
import subprocess
import sys

from pyspark import cloudpickle

from finsearch.functions.stemming import stem
from finsearch.functions.vectors import distances, matrix, nearest_places
from finsearch.operators.vector_search import BandIndex, CellIndex


def test_task_functions_travel_with_their_code(tmp_path):
    payload = tmp_path / "functions.pickle"
    payload.write_bytes(cloudpickle.dumps((stem, distances, matrix, nearest_places, CellIndex, BandIndex)))
    code = f"import pickle; f = pickle.load(open({str(payload)!r}, 'rb')); print(f[0]('relational'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.strip() == "relat", out.stderr
    assert pickle.loads(payload.read_bytes())[0]("cats") == "cat"
