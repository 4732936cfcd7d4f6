import pytest

from plaudit import scratch, session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class FakeSession:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("C", (), {
            "master": master, "applicationId": f"app-{master}", "getCheckpointDir": lambda self: None})()


def test_the_cluster_names_the_folder():
    fake = FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs://shared/checkpoints/"})
    assert scratch.scratch_dir(fake) == "hdfs://shared/checkpoints/plaudit"
    assert scratch.new_path(fake, "x") != scratch.new_path(fake, "x")


def test_without_a_checkpoint_folder_the_warehouse_is_used_on_any_master():
    for master in ("yarn", "local[2]"):
        fake = FakeSession(master, **{"spark.sql.warehouse.dir": "hdfs://shared/warehouse"})
        assert scratch.scratch_dir(fake) == "hdfs://shared/warehouse/plaudit"


def test_scratch_folder_is_gone_after_the_block(spark):
    with scratch.scratch(spark, "gone") as path:
        assert scratch.store(spark.range(3), f"{path}/a").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/a")


def test_materialize_keeps_rows_and_schema_even_when_empty(spark):
    df = spark.range(10).where("id < 0").selectExpr("id", "cast(id AS string) AS name")
    stored = scratch.materialize(df, "empty")
    assert stored.count() == 0 and stored.dtypes == df.dtypes


def test_shuffle_partitions_grow_with_the_data():
    assert session.settings(0, 8)["spark.sql.shuffle.partitions"] == "8"
    assert int(session.settings(100 * 1024**4, 8)["spark.sql.shuffle.partitions"]) == 204800


def test_a_tree_is_released_by_tasks(spark, tmp_path):
    for name in ("a/1.txt", "a/deep/2.txt", "b c/3.txt", "4.txt"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x")
    for path in (f"file://{tmp_path}/tree", str(tmp_path / "empty")):
        (tmp_path / "empty").mkdir(exist_ok=True)
        scratch.release_tree(spark, path)
    assert list(tmp_path.iterdir()) == []
