"""Intermediate tables go to the shared folder only, and go away when asked to."""

import os

import pytest

from strataspark.llm import storage


def test_tables_are_shared_and_discarded(spark):
    d = storage.materialise(spark.range(10), "numbers")
    (path,) = d._written_at
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and d.count() == 10 and os.path.isdir(path)
    storage.discard(d)
    storage.discard(d.filter("id > 1"))  # not a table of its own: nothing happens
    assert not os.path.isdir(path)


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="share"):
        storage.shared_dir(Session())
