"""FASTA sources and gene locations."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import ranked

LOCATION = ("contig", "start", "end", "strand")


def organism_name(path: str) -> str:
    """File name without folder and extension."""
    return re.sub(r"\.[^.]*$", "", os.path.basename(path.rstrip("/")))


def read_fasta(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(genes, organisms) of one file per organism, in the order of ``paths``.

    genes: gene_id (from 1, by file, then record), org_id, desc, sequence, width; empty
    sequences are dropped with a warning.  organisms: org_id, org_name, n_genes; files
    without a record are warned of.  Files are split at record starts, so records are read in parallel.
    """
    names = [organism_name(p) for p in paths]
    if len(set(names)) != len(names):
        raise ValueError("organism names (file names) must differ")
    # a record begins with ">" at the start of a line, and a header may hold one further on
    raw = spark.read.option("lineSep", "\n>").text(paths).select(
        F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.[^.]*$", "").alias("org_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )
    first = F.row_number().over(W.partitionBy("org_name").orderBy("block", "n")) == 1
    # a file's first piece still has its ">", or is what stands before the first record
    records = raw.withColumn("first", first).filter((~F.col("first") & (F.trim("value") != "")) | F.col("value").startswith(">")).withColumn("value", F.when(F.col("first"), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value")))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    parsed = records.select("org_name", "block", "n", F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("desc"), body.alias("sequence"))
    files = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "org_id int, org_name string")
    counted = files.join(parsed.groupBy("org_name").agg(F.count("*").alias("n")), "org_name", "left").collect()
    empty = sorted(r["org_name"] for r in counted if not r["n"])
    if empty:
        warnings.warn(f"no genes in: {', '.join(empty)}", stacklevel=2)


    # ids: a file's own order, after the genes of the files before it
    base, start = {}, 0
    for r in sorted(counted, key=lambda r: r["org_id"]):
        base[r["org_name"]] = start
        start += r["n"] or 0
    offsets = spark.createDataFrame([(i + 1, n, base[n]) for i, n in enumerate(names)], "org_id int, org_name string, base long")
    place = F.row_number().over(W.partitionBy("org_name").orderBy("block", "n"))
    genes = parsed.withColumn("place", place).join(F.broadcast(offsets), "org_name").select((F.col("base") + F.col("place")).alias("gene_id"), "org_id", "desc", "sequence", F.length("sequence").alias("width"))
    if not genes.filter("width = 0").isEmpty():
        warnings.warn("genes of length 0 are dropped", stacklevel=2)
        genes = genes.filter("width > 0")
        ranks = ranked(genes.select("gene_id"), "gene_id", name="_id")
        genes = genes.join(ranks, "gene_id").select(F.col("_id").alias("gene_id"), "org_id", "desc", "sequence", "width")
    organisms = files.join(genes.groupBy("org_id").agg(F.count("*").alias("n_genes")), "org_id", "left").select("org_id", "org_name", F.coalesce("n_genes", F.lit(0)).alias("n_genes"))
    return genes, organisms


def count_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, n): lines that begin with ">" (S2)."""
    return spark.read.text(paths).filter(F.col("value").startswith(">")).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def prodigal_location(genes: DataFrame) -> DataFrame:
    """(gene_id, contig, start, end, strand) from headers "contig_n # start # end # strand # ..." (S7)."""
    part = F.split("desc", " # ")
    return genes.select(
        "gene_id", F.regexp_replace(F.get(part, F.lit(0)), r"_\d+$", "").alias("contig"), *[F.get(part, F.lit(k)).try_cast("int").alias(c) for k, c in ((1, "start"), (2, "end"), (3, "strand"))]
    )


#: Location providers by name.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"prodigal": prodigal_location}


def add_location(genes: DataFrame, location) -> DataFrame:
    """``genes`` with contig, start, end, strand from a provider's name, a DataFrame by gene_id, a list of
    (contig, start, end, strand) in gene order, or a function genes -> such a DataFrame (S8, U1)."""
    if location is None:
        return genes
    if isinstance(location, str):
        if location not in PROVIDERS:
            raise ValueError(f"unknown location provider {location!r}")
        found = PROVIDERS[location](genes)
    elif isinstance(location, DataFrame):
        found = location
    elif isinstance(location, (list, tuple)):
        found = genes.sparkSession.createDataFrame([(k + 1, *row) for k, row in enumerate(location)], "gene_id long, contig string, start int, end int, strand int")
    elif callable(location):
        found = location(genes)
    else:
        raise TypeError("location must be a name, DataFrame, list or function")
    missing = {"gene_id", *LOCATION} - set(found.columns)
    if missing:
        raise ValueError(f"location lacks {sorted(missing)}")
    out = genes.join(found.select("gene_id", *LOCATION), "gene_id", "left")
    bad = out.filter(F.col("contig").isNull() | F.col("start").isNull() | F.col("end").isNull() | ~F.coalesce(F.col("strand").isin(-1, 1), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("every gene needs a contig, start, end and a strand of -1 or 1")
    return out


def normalize_sequences(genes: DataFrame, longer_than: int = 0) -> DataFrame:
    """Upper case without trailing stop signs; records with a non-letter, or of ``longer_than`` residues or fewer, go."""
    clean = genes.withColumn("sequence", F.regexp_replace(F.upper("sequence"), r"\*+$", ""))
    return clean.filter(F.col("sequence").rlike(r"^[A-Z]*$") & (F.length("sequence") > longer_than)).withColumn("width", F.length("sequence"))
