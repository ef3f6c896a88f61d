"""Annotation files (S9): tab separated name, annotation, optional description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect_annotation(rows: DataFrame) -> DataFrame:
    """(name, description, GO, EC) from (name, annot, desc, line): the first description there is, GO terms, all others as EC."""
    first = F.min(F.when(F.col("desc").isNotNull(), F.struct("line", "desc")))["desc"]
    is_go = F.col("annot").contains("GO:")
    lists = [F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("line", "annot")))), lambda x: x["annot"]) for test in (is_go, ~is_go)]
    return rows.groupBy("name").agg(first.alias("description"), lists[0].alias("GO"), lists[1].alias("EC"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """Read ragged lines of two or three fields; a line's place in its file keeps the input order."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).filter(F.trim("value") != "")
    field = F.split("value", "\t")
    rows = lines.select(F.get(field, F.lit(0)).alias("name"), F.get(field, F.lit(1)).alias("annot"), F.get(field, F.lit(2)).alias("desc"), "line")
    return collect_annotation(rows)
