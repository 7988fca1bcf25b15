"""Where steps that are read several times are written."""

import pytest

from momentloom.session import shared_dir, stage


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_folder_or_error():
    a, b = (shared_dir(Session(spark_master="spark://x:7077", spark_checkpoint_dir="hdfs://n/c/"), "s") for _ in range(2))
    assert a.startswith("hdfs://n/c/momentloom/s-") and a != b
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            shared_dir(Session(spark_master=master), "s")
    assert shared_dir(Session(spark_master="local[8]"), "s").endswith("/s")


def test_stage_keeps_rows_and_types(spark):
    df = spark.sql("SELECT 1 AS a, array('x') AS b, CAST(NULL AS BIGINT) AS c")
    assert stage(df, "t").collect() == df.collect() and stage(df, "t").dtypes == df.dtypes
