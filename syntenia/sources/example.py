"""A small example pangenome (S11): genomes of related genes, made by rule."""

from __future__ import annotations

import os
import random

from pyspark.sql import SparkSession

RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def write_example(folder: str, genomes: int = 5, families: int = 12, seed: int = 7) -> tuple[list[str], list[int]]:
    """FASTA files (headers give locations) in a local folder, and the family of each gene in gene order.

    Every genome has most families in the same order on one contig, each gene a lightly changed copy of its family's first.
    """
    r = random.Random(seed)
    first = ["".join(r.choice(RESIDUES) for _ in range(r.randint(60, 120))) for _ in range(families)]
    paths, groups = [], []
    for g in range(genomes):
        lines, at = [], 1
        for f, text in enumerate(first):
            if f % 4 == 3 and (f + g) % 3 == 0:
                continue  # not in every genome
            letters = list(text)
            for k in r.sample(range(len(letters)), 2 * (g > 0)):
                letters[k] = r.choice(RESIDUES)
            end = at + 3 * len(letters) - 1
            lines.append(f">genome{g + 1}_contig_{f + 1} # {at} # {end} # {1 if f % 3 else -1} # ID=1_{f + 1}\n{''.join(letters)}\n")
            groups.append(f + 1)
            at = end + 50
        paths.append(os.path.join(folder, f"genome{g + 1}.fasta"))
        with open(paths[-1], "w") as out:
            out.writelines(lines)
    return paths, groups


def load_example(spark: SparkSession, folder: str, *, low_mem: bool = False, locations: bool = False, groups: bool = False, paralogues: bool = False):
    """The example as a pangenome; grouped by family, and with neighboring families linked, if asked for."""
    from ..pangenome import Pangenome

    paths, own = write_example(folder)
    out = Pangenome.load(spark, paths, True, "prodigal" if locations else None, low_mem)
    if groups or paralogues:
        out = out.manual_grouping(own)
    if paralogues:
        links = spark.createDataFrame([(g, (g + 1) // 2) for g in sorted(set(own))], "group_id long, paralogue long")
        out = out.add_group_info(links)
    return out
