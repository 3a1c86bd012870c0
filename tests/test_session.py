"""The shared folder where the session names none, or names it without a scheme."""

from loomgraph import session


class Unset:
    """A session whose settings lack the folder."""

    def __init__(self, spark, where=None):
        self.spark, self.where = spark, where

    def __getattr__(self, name):
        return getattr(self.spark, name)

    @property
    def conf(self):
        return self

    def get(self, key, default=None):
        return self.where if key == "spark.checkpoint.dir" else self.spark.conf.get(key, default)


def test_folder(spark, tmp_path):
    own = session.shared_dir(Unset(spark))
    assert own.startswith("file:///") and session.shared_dir(Unset(spark)) == own
    assert session.shared_dir(Unset(spark, str(tmp_path))) == f"file://{tmp_path}"
    assert session.shared_dir(Unset(spark, "hdfs://a/b/")) == "hdfs://a/b"
    assert session.new_path(Unset(spark), "x").startswith(own + "/x-")
