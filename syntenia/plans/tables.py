"""Intermediate tables of iterative plans, in the folder that all executors share.

A table lives until it is discarded: by :func:`discard` as soon as what was made of it has been written, at the
end of a :func:`scope`, or, where a returned DataFrame still reads it, when the Python process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Settings of a write: a plan's shuffle files go when its write has ended, not when the driver happens to collect its garbage,
#: and Python workers get batches that stay small where rows are long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

_own: list[str] = []
_live: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder only where it is unset on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="syntenia-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, which is removed with the tables."""
    path = f"{shared_dir(spark)}/syntenia/{label}-{uuid.uuid4().hex}"
    if not _live:
        atexit.register(_discard_all)
    _live[path] = spark
    return path


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Holds :data:`WRITING`, also for what threads write meanwhile."""
    conf = spark.conf
    before = {key: conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def write(df: DataFrame, path: str, by: str | None = None, **options: str) -> None:
    """Write ``df`` as Parquet under :data:`WRITING`, in a folder for each value of ``by`` if given."""
    with writing(df.sparkSession):
        df.write.options(**options).parquet(path, partitionBy=by)


def materialize(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, label)
    write(df, path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def remove(path: str) -> None:
    """Delete what is at a path of :func:`new_path`."""
    spark = _live.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize`; nothing may read them any more."""
    for t in tables:
        if (path := getattr(t, "_table_path", None)) is not None:
            remove(path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Discards every table made inside that is still there, but for those put into the list that it gives."""
    before, spared = set(_live), []
    try:
        yield spared
    finally:
        before.update(getattr(t, "_table_path", None) for t in spared)
        for path in [p for p in _live if p not in before]:
            remove(path)


def _discard_all() -> None:
    for path in list(_live):
        with suppress(Exception):  # the session may be gone
            remove(path)
