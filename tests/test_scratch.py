import pytest

from linkloom.sources import scratch


class Session:
    """What scratch.folder asks of a session."""

    def __init__(self, master, base):
        self.sparkContext = type("C", (), {"applicationId": "app-1", "master": master})()
        self.conf = type("F", (), {"get": staticmethod(lambda key, other: base)})()


def test_folder_is_the_shared_one_and_local_only_for_one_process():
    assert scratch.folder(Session("spark://h:7077", "hdfs://x/y")) == "hdfs://x/y/linkloom-app-1"
    assert scratch.folder(Session("local[4]", None)).startswith("file:///")
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.folder(Session(master, None))


def test_kept_tables_are_read_again_and_cleared(spark):
    d = scratch.keep(spark.range(5), "five")
    assert d.count() == 5 and scratch.folder(spark) in d.inputFiles()[0]
