"""A session whose configuration names no checkpoint folder."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

CODE = """
from reachlab.session import get_session
spark = get_session("local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
from reachlab.plans import base
df = base.memo(spark, "nowhere", "numbers", lambda: spark.range(5))
assert df.count() == 5 and spark.range(3).checkpoint().count() == 3
try:
    from reachlab.llm.common import materialise
except ModuleNotFoundError:
    pass
else:
    assert materialise(spark.range(7), "numbers").count() == 7
print("done")
"""


def test_a_session_without_the_setting_can_materialise():
    conf = tempfile.mkdtemp(prefix="reachlab-conf-", dir="/tmp")
    env = {**os.environ, "SPARK_CONF_DIR": conf, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
