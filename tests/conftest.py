"""Shared fixtures: one local Spark session for the whole test run."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from reachlab.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="reachlab-tests")
    yield s
    s.stop()
