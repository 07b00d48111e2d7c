"""Scratch tables: where they lie and how they go."""

import os
from types import SimpleNamespace

import pytest

from tidemark.llm import shared


def test_tables_are_discarded(spark):
    shared.discard(spark)
    df = shared.written(spark.range(3).toDF("x"), "some")
    path = shared.MADE[spark.sparkContext.applicationId][-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    assert shared.discard(spark) == 1 and not os.path.exists(path) and shared.discard(spark) == 0


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared.folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
