"""The shared folder, with and without the setting."""

import os
import pathlib
import subprocess
import sys

CODE = """
from treegauge.session import cut_lineage, local_session, shared_dir
s = local_session("1")
assert s.conf.get("spark.checkpoint.dir", None) is None
d = shared_dir(s)
assert d == shared_dir(s)
assert cut_lineage(s.range(5)).count() == 5
"""


def test_works_with_an_empty_spark_configuration(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]


def test_no_two_test_files_share_a_name():
    names = [p.name for p in pathlib.Path(__file__).parent.rglob("test_*.py")]
    assert len(names) == len(set(names))
