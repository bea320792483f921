"""Settings, size-checked broadcasts and written intermediates."""

import pytest

import tripleweft as tw
from tripleweft.session import SHUFFLE_BYTES, broadcast_if_small, scratch_dir


def test_configure_only_raises_the_number_of_partitions(spark):
    key, advised = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        tw.configure(spark, 10)
        assert spark.conf.get(key) == before
        tw.configure(spark, 1000 * SHUFFLE_BYTES + 1)
        assert spark.conf.get(key) == "1001" and spark.conf.get(advised) == str(64 << 20)
        tw.configure(spark, 100 << 40)
        assert 64 << 20 < int(spark.conf.get(advised)) < 512 << 20
    finally:
        spark.conf.set(key, before)
        spark.conf.unset(advised)
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"


def test_broadcast_needs_a_small_count(spark):
    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    small, large = spark.range(10), spark.range(11)
    assert hinted(broadcast_if_small(small, 10)) and not hinted(broadcast_if_small(large, 10))


def test_writing_no_reductions(spark, tmp_path):
    none = spark.createDataFrame([], "name STRING, s STRING, p STRING, o STRING")
    for _ in range(2):
        assert tw.write_reductions(none, str(tmp_path / "none")).isEmpty()
    assert tw.read_stored(spark, str(tmp_path / "none"), ["a"], encoded=False) == {}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session)


def test_splits_and_joins_follow_the_input(spark):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"]
    before = spark.conf.get(keys[0])
    try:
        tw.configure(spark, 6 << 30)  # 600 million triples: some 400,000 a partition
        assert [int(spark.conf.get(key)) for key in keys] == [1536, 64 << 20, 16 << 20, 64 << 20]
        spark.conf.set(keys[0], before)
        tw.configure(spark, 100 << 40)
        assert int(spark.conf.get(keys[0])) == 102_400 and int(spark.conf.get(keys[2])) == 128 << 20
    finally:
        spark.conf.set(keys[0], before)
        for key in keys[1:]:
            spark.conf.unset(key)
