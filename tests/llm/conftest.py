import os
from pathlib import Path

import pytest

REPO = Path(__file__).parents[2]


@pytest.fixture(autouse=True)
def elsewhere(monkeypatch):
    """What a test starts does not inherit a path to the package."""
    rest = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO]
    monkeypatch.setenv("PYTHONPATH", os.pathsep.join(rest))
