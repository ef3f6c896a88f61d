"""Intermediate tables go when nothing reads them any more."""

import pytest
from pyspark.sql import functions as F

from syntenia.operators.components import components
from syntenia.plans import tables


class Cluster:
    """Stands for a session on a cluster without a shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


def test_scope_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    with tables.scope():
        edges = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        assert components(spark.range(60).toDF("node"), edges).groupBy("component").count().count() == 10
        assert list(tmp_path.rglob("*.parquet"))
    assert not list(tmp_path.rglob("*.parquet"))
    kept = tables.materialize(spark.range(3))
    assert kept.count() == 3
    tables.discard(kept)
    assert not list(tmp_path.rglob("*.parquet"))


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster())
