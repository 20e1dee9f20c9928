from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from statelens.session import build_session

    # local tests bring their own shared folder, warehouse included
    at = tmp_path_factory.mktemp("spark")
    os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])
    s = build_session("tests", "4", 4, spark__checkpoint__dir=str(at / "shared"), spark__sql__warehouse__dir=str(at / "warehouse"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
