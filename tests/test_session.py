import os
import types

import pytest

from millrace import session


def test_cuts_are_read_again_and_dropped(spark):
    df = session.cut(spark.range(5))
    assert df.count() == 5 and "cuts-" in df.inputFiles()[0]
    session.drop_cuts(spark)
    assert not os.path.exists(df.inputFiles()[0].removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    none = types.SimpleNamespace(isDefined=lambda: False)
    jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none))
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        sc = types.SimpleNamespace(_jsc=jsc, master=master, getConf=lambda: types.SimpleNamespace(get=lambda _: None))
        fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *_: None))
        with pytest.raises(ValueError):
            session.checkpoint_dir(fake)
