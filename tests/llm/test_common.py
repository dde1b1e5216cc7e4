import os

import pytest
from pyspark.sql import functions as F

from helixframe.llm import common


def files(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(len(f) for _, _, f in os.walk(top))


def test_cut_and_release(spark):
    df = common.cut(spark.range(100).select(F.xxhash64("id").alias("h")).groupBy("h").count())
    held = files(spark)
    again = common.cut(df.select("h"))
    assert df.count() == again.count() == 100 and files(spark) > held
    common.release(again)
    assert files(spark) == held and df.count() == 100
    common.release(df.select("h"))  # not a result of cut: nothing happens
    assert df.count() == 100 and spark.conf.get(common.CLEANUP) == "false"


@pytest.mark.parametrize("most", [1 << 26, 5])
def test_sieve_lets_all_of_the_keys_pass(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_KEYS", most)
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.filter("id % 50 = 7").select(F.col("h").alias("k"))
    got = common.sieve(rows, keys, "h", "k")
    assert got.columns == ["id", "h"] and got.filter("id % 50 = 7").count() == 100 and got.count() < 2500
    assert common.sieve(rows, keys.limit(0), "h", "k").count() == 0


def test_spare_names():
    assert common.spare(["a", "__H"], "h", "id") == ["___h", "___id"]
    assert common.spare([], "h") == ["__h"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        common.cut(type("Frame", (), {"sparkSession": Session()})())
