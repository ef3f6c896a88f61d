"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each class.

Plan.  One scan hashes every text; the hashes (not the texts) are counted with
map-side combine.  Only texts whose hash occurs more than once are read again
and grouped by (hash, bytes), so equal hashes of different bytes fall apart and
a class of any size leaves each map task as a single row.  Rows then look up
their class by (hash, SHA-256); Spark's skew join splits a hot class.

Defined cases: null text counts as empty and empty texts are equal; A-Z are
lower-cased, nothing else; ids that tie or repeat are one document, so equal
rows with the kept id are all marked kept; a null id is kept only where its
class has no other id; an empty table gives an empty result; other columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "smallest" or "largest" id of equal texts.  ``digest`` maps the
    normalised text to its grouping hash (a weaker one only costs time).
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("doc_id"), store.ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    hashed = store.keep(texts.select("doc_id", digest(F.col("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256")), "hashed")
    repeated = store.keep(hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    repeated = store.small(repeated)
    same_bytes = (
        texts.select("doc_id", "norm", digest(F.col("norm")).alias("h"))
        .join(repeated, "h", "left_semi")
        .groupBy("h", "norm")
        .agg(F.count("*").alias("n"), pick("doc_id").alias("keep_id"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), "n", "keep_id")
    )
    return hashed.join(store.keep(same_bytes, "classes"), ["h", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, *, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts: that of the kept id; of several rows with that id one."""
    null = F.col(id_col).isNull()
    keys = store.row_keys(F.col(id_col), F.col(text_col))
    # a null id loses to any other
    row = F.struct((null if keep == "smallest" else ~null).alias("none"), F.col(id_col).alias("id"), *keys)
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    found = exact_groups(rows, id_col="row", text_col="text", keep=keep).filter("group_size > 1").select("doc_id.k", "doc_id.l", "kept")
    found = store.keep(found, "rows")
    lost = store.keep(found.filter("NOT kept").select("k", "l").distinct(), "lost")
    repeated = store.keep(found.filter("kept").groupBy("k", "l").agg(F.count("*").alias("n")).filter("n > 1").select("k", "l"), "repeated")
    store.drop(found)
    return store.kept_rows(docs, keys, lost, repeated)
