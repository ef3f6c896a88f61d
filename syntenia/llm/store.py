"""Where intermediate tables live, and small column helpers shared by the operators.

Every table an operator keeps between two passes is written as Parquet below
``spark.checkpoint.dir`` (read from the session), which all executors of a
cluster share.  A lost executor therefore costs the tasks it ran, never a table.
:func:`drop` deletes a table once what was made of it has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import discard as drop
from ..plans.tables import materialize, new_path, scope, write  # noqa: F401

#: What separates words: space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys up to which a table of them is broadcast: at most some 60 MB.
BROADCAST_KEYS = 1_000_000


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table (lineage is cut)."""
    return materialize(df, label, compression="zstd")


def fresh(label: str = "key") -> str:
    """A column name that no table has."""
    return f"_{label}_{uuid.uuid4().hex}"


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two hashes (k, l) that tell rows apart by id and text; rows of the same id and text are the same document."""
    parts = [id_col, id_col.isNull(), text, text.isNull()]
    return [F.xxhash64(*parts).alias("k"), F.xxhash64(F.lit(1), *reversed(parts)).alias("l")]


def small(keys: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if its checked size allows."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def kept_rows(docs: DataFrame, keys: list[Column], lost: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs``, which must be the same whenever read, less rows whose keys are in ``lost`` (k, l), and with one of those in ``repeated`` (k, l)."""
    names = [fresh(), fresh()]
    rows = docs.select("*", *[c.alias(n) for c, n in zip(keys, names, strict=True)])
    out = rows.join(small(lost.toDF(*names)), names, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated.toDF(*names))
        out = out.join(again, names, "left_anti").unionByName(out.join(again, names, "left_semi").dropDuplicates(names))
    return out.drop(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
