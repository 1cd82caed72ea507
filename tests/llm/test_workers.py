"""Executors need no copy of the package: queries run from another folder with nothing on the path."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from tidesift.session import build_session
spark = build_session("workers", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"}})
for name, run in entry.queries().items():
    if name.startswith("op"):
        assert run(spark, {sf_dir!r}).count() > 0, name
spark.stop()
print("all ran")
"""


def test_queries_run_without_the_package_on_the_path(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, sf_dir=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert done.returncode == 0 and "all ran" in done.stdout, done.stderr[-3000:]
