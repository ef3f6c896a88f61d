"""Growth by arriving FASTA files (2.13): each micro-batch of files is one ``add_genomes`` on the state kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..pangenome import Pangenome


def grow_on_arrival(spark: SparkSession, folder: str, state: Callable[[], Pangenome], store: Callable[[Pangenome], None], checkpoint: str, **how) -> StreamingQuery:
    """Watch ``folder`` for FASTA files; ``state`` loads the pangenome so far, ``store`` keeps the grown one."""

    def batch(files: DataFrame, _: int) -> None:
        paths = sorted(r["path"] for r in files.select("path").distinct().collect())
        if paths:
            now = state()
            store(now.add_genomes(Pangenome.load(spark, paths, now.translated, "prodigal" if now.has_location else None), **how))

    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"))
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
