import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


import pytest


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    """Small tables in few tasks."""
    from tessella.llm import repeats

    monkeypatch.setattr(repeats, "PARTS", 4)
