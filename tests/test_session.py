import os
import subprocess
import sys

import pytest

from marklight import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class Fake:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {"master": master})


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Fake(master))
    assert session.shared_dir(Fake("yarn", **{"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    one = Fake("local[3]")
    assert session.shared_dir(one) == session.shared_dir(one) and os.path.isdir(session.shared_dir(one)[7:])


def test_cut_tables_are_freed(spark):
    df = session.cut(spark.range(5).toDF("x"))
    path = df._marklight_cut.removeprefix("file:").replace("///", "/")
    assert df.count() == 5 and os.path.isdir(path)
    session.free(df, df, spark.range(1))
    assert not os.path.exists(path)


def test_python_stages_run_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))!r})
from marklight.session import local_session, ship
from marklight.operators import fingerprint as fp
s = local_session("elsewhere", 1, 1)
ship(s)
u = fp.c_units(s.createDataFrame([(1, bytearray(b"int f(int a) {{ return a + 1; }}"))], "id int, content binary"), 2)
assert u.count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr[-2000:]
