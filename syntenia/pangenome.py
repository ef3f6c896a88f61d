"""The pangenome object: immutable DataFrames and settings; every operation returns a new one."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.kmers import org_kmer_distance, org_kmer_similarity, transform_sim
from .functions.pairs import similar_pairs
from .operators import clustering as C
from .operators import graph as G
from .operators import matrix as M
from .operators import neighbors as N
from .operators import splitting as S
from .operators import tree as T
from .operators.components import components
from .plans.ranks import ranked
from .plans.tables import materialize
from .settings import DEFAULTS, change, resolve
from .sources.fasta import LOCATION, add_location, read_fasta

SEQUENCE = ("desc", "sequence", "width")


def match_groups(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, group_id): each new group gets the old id of greatest overlap, greedily over all pairs; the
    others get ids after the greatest old one (J13, M13).

    Rounds of mutual best pairs give the greedy result (overlaps are ordered totally, so the best pair left is always
    mutual) without one task seeing all pairs.
    """
    overlap = new.select("gene_id", F.col("group_id").alias("new_id")).join(old.select("gene_id", "group_id"), "gene_id").groupBy("new_id", "group_id").agg(F.count("*").alias("n"))
    left = materialize(overlap, "overlap")
    done: DataFrame | None = None
    while not left.isEmpty():
        by_new = W.partitionBy("new_id").orderBy(F.col("n").desc(), "new_id", "group_id")
        by_old = W.partitionBy("group_id").orderBy(F.col("n").desc(), "new_id", "group_id")
        best = left.withColumn("a", F.row_number().over(by_new)).withColumn("b", F.row_number().over(by_old)).filter("a = 1 AND b = 1").select("new_id", "group_id")
        best = materialize(best, "best")
        done = best if done is None else done.unionByName(best)
        left = materialize(left.join(best.select("new_id"), "new_id", "left_anti").join(best.select("group_id"), "group_id", "left_anti"), "overlap")
    if done is None:
        done = overlap.select("new_id", "group_id").limit(0)
    rest = new.select(F.col("group_id").alias("new_id")).distinct().join(done, "new_id", "left_anti")
    top = old.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top"))
    fresh = ranked(rest, "new_id", name="_n").crossJoin(F.broadcast(top)).select("new_id", (F.col("top") + F.col("_n")).alias("group_id"))
    return done.unionByName(fresh)


def group_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(gene_id, old_group, new_group, change): genes that moved, came or went."""
    both = old.select("gene_id", F.col("group_id").alias("old_group")).join(new.select("gene_id", F.col("group_id").alias("new_group")), "gene_id", "full")
    what = F.when(F.col("old_group").isNull(), "added").when(F.col("new_group").isNull(), "removed").otherwise("moved")
    return both.filter(~F.col("old_group").eqNullSafe(F.col("new_group"))).withColumn("change", what)


def report_changes(new: DataFrame, old: DataFrame, path: str | None = None, most: int = 50) -> DataFrame:
    """(line): who moved where, and how many groups came or went (S13, M15); written as text if ``path`` is given.

    Without a path more than ``most`` lines of moves are warned of, and are in the result all the same.
    """
    moved = group_changes(new, old).filter("change = 'moved'")
    lists = moved.groupBy("old_group", "new_group").agg(F.sort_array(F.collect_list("gene_id")).alias("genes"))
    ids = F.array_join(F.transform("genes", lambda g: g.cast("string")), ", ")
    line = F.concat(F.lit("Gene "), ids, F.lit(" moved from group "), F.col("old_group").cast("string"), F.lit(" to "), F.col("new_group").cast("string"))
    moves = lists.select(F.lit(0).alias("part"), F.col("old_group").alias("a"), F.col("new_group").alias("b"), line.alias("line"))
    was, now = old.select("group_id").distinct(), new.select("group_id").distinct()
    counts = [x.join(y, "group_id", "left_anti").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(k).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.col("n").cast("string"), F.lit(text)).alias("line")) for k, x, y, text in ((1, now, was, " new groups added"), (2, was, now, " empty groups removed"))]
    out = moves.unionByName(counts[0]).unionByName(counts[1]).orderBy("part", "a", "b").select("line")
    if path is not None:
        out.write.text(path)
    elif moves.limit(most + 1).count() > most:
        warnings.warn(f"more than {most} changes of gene groups; give a path to write them", stacklevel=2)
    return out


@dataclass(frozen=True)
class Pangenome:
    """genes(gene_id, org_id[, group_id][, desc, sequence, width][, contig, start, end, strand]), organisms(org_id, org_name, ...), group metadata."""

    genes_: DataFrame
    organisms: DataFrame
    translated: bool = True
    group_meta: DataFrame | None = None
    settings: dict[str, Any] = field(default_factory=dict)

    # -- construction ------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, paths: list[str], translated: bool, location=None, low_mem: bool = False, **settings: Any) -> Pangenome:
        """From FASTA files (S1).  ``low_mem`` keeps reading the files lazily; else genes are written once to the shared folder."""
        genes, organisms = read_fasta(spark, paths)
        genes = add_location(genes, location)
        return cls(genes if low_mem else materialize(genes, "genes"), organisms, translated, None, change({}, **settings))

    def _with(self, **new: Any) -> Pangenome:
        return replace(self, **new)

    # -- state ---------------------------------------------------------------------------

    def has(self, *columns: str) -> bool:
        return set(columns) <= set(self.genes_.columns)

    @property
    def has_groups(self) -> bool:
        return self.has("group_id")

    @property
    def has_location(self) -> bool:
        return self.has(*LOCATION)

    @property
    def has_paralogue_links(self) -> bool:
        return self.group_meta is not None and "paralogue" in self.group_meta.columns and self.group_meta.filter("paralogue IS NULL").isEmpty()

    def _need(self, *columns: str) -> DataFrame:
        if not self.has(*columns):
            raise ValueError(f"this pangenome has no {', '.join(c for c in columns if c not in self.genes_.columns)}")
        return self.genes_

    def get(self, **given: Any) -> dict[str, Any]:
        return resolve(self.settings, **given)

    def default(self, name: str) -> Any:
        return self.settings.get(name, DEFAULTS[name])

    def set_defaults(self, **new: Any) -> Pangenome:
        """A new core threshold changes every group's class, as classes are derived when asked for."""
        return self._with(settings=change(self.settings, **new))

    # -- accessors -----------------------------------------------------------------------

    def n_genes(self) -> int:
        return self.genes_.count()

    def n_organisms(self) -> int:
        return self.organisms.count()

    def n_groups(self) -> int:
        return self._need("group_id").select("group_id").distinct().count()

    def genes(self, split: str | None = None, subset: list | DataFrame | None = None) -> DataFrame:
        """Sequences, or arrays of them by organism, group or paralogue (P2, P3); ``subset`` of genes or of the split's keys, a list or a table of one column."""
        g = self._need("sequence")

        def chosen(rows: DataFrame, key: str) -> DataFrame:
            if subset is None:
                return rows
            if isinstance(subset, DataFrame):
                return rows.join(subset.toDF(key), key, "left_semi")
            return rows.filter(F.col(key).isin(list(subset)))

        if split is None:
            return chosen(g, "gene_id")
        if split in ("paralogue", "paralog"):
            if not self.has_paralogue_links:
                raise ValueError("paralogues are not linked")
            g, key = self._need("group_id").join(self.group_meta.select("group_id", "paralogue"), "group_id"), "paralogue"
        elif split == "group":
            g, key = self._need("group_id"), "group_id"
        elif split == "organism":
            key = "org_id"
        else:
            raise ValueError(f"unknown split {split!r}")
        return chosen(g, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("gene_id", "sequence"))).alias("genes"))

    def gene_names(self) -> DataFrame:
        return self._need("desc").select("gene_id", F.col("desc").alias("name"))

    def with_gene_names(self, names: DataFrame) -> Pangenome:
        new = names.select("gene_id", F.col("name").alias("_n"))
        return self._with(genes_=self._need("desc").join(new, "gene_id", "left").withColumn("desc", F.coalesce("_n", "desc")).drop("_n"))

    def location(self) -> DataFrame:
        return self._need(*LOCATION).select("gene_id", *LOCATION)

    def with_org_names(self, names: dict[int, str]) -> Pangenome:
        pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        return self._with(organisms=self.organisms.withColumn("org_name", F.coalesce(pairs[F.col("org_id")], F.col("org_name"))))

    def matrix(self) -> DataFrame:
        return M.pan_matrix(self._need("group_id"))

    def group_info(self) -> DataFrame:
        """Counts, class, name and all metadata of each group."""
        info = M.group_info(self._need("group_id"), self.n_organisms(), self.default("core_threshold"))
        name = F.concat(F.lit(self.default("group_prefix")), F.col("group_id").cast("string"))
        if self.group_meta is None:
            return info.withColumn("group_name", name)
        info = info.join(self.group_meta, "group_id", "left")
        return info.withColumn("group_name", F.coalesce("group_name", name) if "group_name" in info.columns else name)

    def all_groups(self) -> DataFrame:
        """:meth:`group_info` with a row of zeros for every id up to the greatest that no gene has."""
        info = self.group_info()
        top = info.agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0]
        ids = self.genes_.sparkSession.range(1, top + 1).withColumnRenamed("id", "group_id")
        return ids.join(info, "group_id", "left").fillna(0, ["n_org", "n_genes"])

    def next_group(self) -> int:
        """The id that the next new group gets."""
        return self._need("group_id").agg(F.coalesce(F.max("group_id"), F.lit(0))).first()[0] + 1

    def with_group_names(self, names: dict[int, str]) -> Pangenome:
        """Groups renamed (P6); other groups keep theirs."""
        given = self.genes_.sparkSession.createDataFrame([(int(k), v) for k, v in names.items()], "group_id long, group_name string")
        return self.add_group_info(given)

    def summary(self) -> dict[str, Any]:
        """Counts, and percent of groups by class."""
        out: dict[str, Any] = {"organisms": self.n_organisms(), "genes": self.n_genes()}
        if self.has_groups:
            out["groups"] = self.n_groups()
            out["classes"] = {r["class"]: r["percent"] for r in M.class_percent(self.group_info()).collect()}
        return out

    # -- subsetting and modification -------------------------------------------------------

    def subset(self, organisms: list[int] | list[str] | list[bool]) -> Pangenome:
        """Organisms by id, name or mask, in their old order, renumbered (P11); repeated or absent ids are warned of."""
        wanted = list(organisms)
        ids = [(r["org_id"], r["org_name"]) for r in self.organisms.select("org_id", "org_name").orderBy("org_id").collect()]
        if wanted and all(isinstance(x, bool) for x in wanted):
            keep = [i for k, (i, _) in enumerate(ids) if wanted[k % len(wanted)]]
        elif wanted and isinstance(wanted[0], str):
            by_name = {n: i for i, n in ids}
            if missing := [x for x in wanted if x not in by_name]:
                raise KeyError(f"unknown organisms: {missing}")
            keep = [by_name[x] for x in wanted]
        else:
            known = {i for i, _ in ids}
            keep = [x for x in wanted if x in known]
            if len(keep) < len(wanted):
                warnings.warn("absent organisms are ignored", stacklevel=2)
        if len(set(keep)) < len(keep):
            warnings.warn("repeated organisms are ignored", stacklevel=2)
        keep = sorted(set(keep))
        return self._keep_genes(self.genes_.filter(F.col("org_id").isin(keep)), self.organisms.filter(F.col("org_id").isin(keep)))

    def organism(self, org_id: int) -> DataFrame:
        return self._need("sequence").filter(F.col("org_id") == org_id)

    def _keep_genes(self, genes: DataFrame, organisms: DataFrame | None = None) -> Pangenome:
        """Drop emptied organisms and groups, number densely anew, recount genes."""
        genes = materialize(genes, "kept")
        present = genes.groupBy("org_id").agg(F.count("*").alias("n_genes"))
        organisms = (self.organisms if organisms is None else organisms).drop("n_genes").join(present, "org_id")
        org = organisms.select("org_id", F.row_number().over(W.orderBy("org_id")).alias("_o"))
        ids = ranked(genes.select("gene_id"), "gene_id", name="_g")
        genes = genes.join(org, "org_id").join(ids, "gene_id").withColumn("org_id", F.col("_o")).withColumn("gene_id", F.col("_g")).drop("_o", "_g")
        organisms, meta = organisms.join(org, "org_id").withColumn("org_id", F.col("_o")).drop("_o"), self.group_meta
        if self.has_groups:
            groups = ranked(genes.select("group_id").distinct(), "group_id", name="_n")
            genes = genes.join(groups, "group_id").withColumn("group_id", F.col("_n")).drop("_n")
            meta = None if meta is None else meta.join(groups, "group_id").withColumn("group_id", F.col("_n")).drop("_n")
        return self._with(genes_=genes, organisms=organisms, group_meta=meta)

    def remove_genes(self, *, ids: list[int] | None = None, names: list[str] | None = None, organisms: list | None = None, groups: list | None = None, ind: list[int] | None = None) -> Pangenome:
        """Without genes by id, by name (in the paired organisms), by organism or group, or the ind-th gene of each (M1-M8).

        Nothing that matches is a warning and leaves the pangenome as it is.
        """
        g, spark = self.genes_, self.genes_.sparkSession
        if organisms and isinstance(organisms[0], str):
            by_name = {r["org_name"]: r["org_id"] for r in self.organisms.select("org_id", "org_name").collect()}
            organisms = [by_name.get(x, -1) for x in organisms]
        if groups and isinstance(groups[0], str):
            groups = [int(x.removeprefix(self.default("group_prefix"))) for x in groups]
        if ids is not None:
            lost = g.filter(F.col("gene_id").isin(list(ids)))
        elif names is not None and organisms is not None:
            many = max(len(names), len(organisms))
            pairs = spark.createDataFrame([(names[k % len(names)], int(organisms[k % len(organisms)])) for k in range(many)], "desc string, org_id int")
            lost = self._need("desc").join(F.broadcast(pairs), ["desc", "org_id"], "left_semi")
        elif names is not None:
            lost = self._need("desc").filter(F.col("desc").isin(list(names)))
        elif organisms is not None or groups is not None:
            key, values = ("org_id", organisms) if organisms is not None else ("group_id", groups)
            lost = self._need(key).filter(F.col(key).isin([int(x) for x in values]))
            if ind is not None:
                many = max(len(values), len(ind))
                pairs = spark.createDataFrame([(int(values[k % len(values)]), int(ind[k % len(ind)])) for k in range(many)], f"{key} long, place int")
                lost = lost.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("gene_id"))).join(F.broadcast(pairs), [key, "place"], "left_semi")
        else:
            raise ValueError("say which genes")
        lost = materialize(lost.select("gene_id"), "lost")
        if lost.isEmpty():
            warnings.warn("no gene matches; nothing removed", stacklevel=2)
            return self
        return self._keep_genes(g.join(lost, "gene_id", "left_anti"))

    def add_group_info(self, info: DataFrame, key: str = "group_id") -> Pangenome:
        """Metadata by group id, or by another column of the group table (M9)."""
        if bad := {"n_genes", "n_org", "class"} & set(info.columns):
            raise ValueError(f"{sorted(bad)} cannot be set")
        known = self.group_info()
        keyed = info if key == "group_id" else known.select("group_id", F.col(key)).join(info, key).drop(key)
        base = known.select("group_id") if self.group_meta is None else self.group_meta
        fresh = keyed.toDF(*[c if c == "group_id" else f"_new_{c}" for c in keyed.columns])
        out = base.join(fresh, "group_id", "left")
        for c in keyed.columns:
            if c != "group_id":
                old = [F.col(c)] if c in base.columns else []
                out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), *old)).drop(f"_new_{c}")
        return self._with(group_meta=materialize(out, "groups"))

    def add_org_info(self, info: DataFrame, key: str = "org_id") -> Pangenome:
        """Metadata by organism id or name."""
        if "n_genes" in info.columns:
            raise ValueError("n_genes cannot be set")
        old = [c for c in self.organisms.columns if c == key or c not in info.columns]
        return self._with(organisms=self.organisms.select(*old).join(info, key, "left"))

    def merge(self, other: Pangenome) -> Pangenome:
        """Both pangenomes' organisms, genes and groups, ids of ``other`` after these."""
        top = lambda df, c: df.agg(F.coalesce(F.max(c), F.lit(0))).first()[0]
        o, g = top(self.organisms, "org_id"), top(self.genes_, "gene_id")
        genes, organisms, meta = other.genes_, other.organisms.withColumn("org_id", F.col("org_id") + o), other.group_meta
        genes = genes.withColumn("org_id", F.col("org_id") + o).withColumn("gene_id", F.col("gene_id") + g)
        if self.has_groups and other.has_groups:
            s = top(self.genes_, "group_id")
            genes = genes.withColumn("group_id", F.col("group_id") + s)
            meta = None if meta is None else meta.withColumn("group_id", F.col("group_id") + s)
        both = meta if self.group_meta is None else self.group_meta if meta is None else self.group_meta.unionByName(meta, allowMissingColumns=True)
        return self._with(genes_=self.genes_.unionByName(genes, allowMissingColumns=True), organisms=self.organisms.unionByName(organisms, allowMissingColumns=True), group_meta=both)

    def slim(self) -> Pangenome:
        """Without sequences."""
        return self._with(genes_=self.genes_.drop(*SEQUENCE))

    # -- grouping --------------------------------------------------------------------------

    def with_groups(self, groups: DataFrame) -> Pangenome:
        """Grouped by (gene_id, group_id)."""
        return self._with(genes_=materialize(C.manual_grouping(self.genes_, groups), "grouped"), group_meta=None)

    def manual_grouping(self, groups: list) -> Pangenome:
        """Groups as one id per gene (in gene order), or as lists of gene ids."""
        spark = self.genes_.sparkSession
        if groups and isinstance(groups[0], (list, tuple, set)):
            return self.with_groups(C.grouping_from_lists(spark, [list(g) for g in groups]))
        if len(groups) != self.n_genes():
            raise ValueError("one group for each gene")
        return self.with_groups(spark.createDataFrame([(k + 1, int(g)) for k, g in enumerate(groups)], "gene_id long, group_id long"))

    def identity_grouping(self, **how: Any) -> Pangenome:
        """Greedy identity clustering at ever lower limits."""
        how = {"lower": self.default("lower_limit"), "k": self.default("kmer_size"), "max_length_dif": self.default("max_length_dif")} | how
        return self.with_groups(C.identity_grouping(self._need("sequence"), **how))

    def kmer_similarity(self, kmer_size: int | None = None, lower_limit: float | None = None, rescale: bool | None = None, transform: Callable | None = None) -> DataFrame:
        """(i, j, sim) of genes."""
        p = self.get(kmer_size=kmer_size, lower_limit=lower_limit, rescale=rescale, transform=transform)
        edges = similar_pairs(self._need("sequence"), p["kmer_size"], p["lower_limit"])
        return transform_sim(edges, p["lower_limit"], p["rescale"], p["transform"])

    def graph_grouping(self, similarity: DataFrame | None = None, algorithm: str | None = None) -> Pangenome:
        edges = self.kmer_similarity() if similarity is None else similarity
        return self.with_groups(C.graph_grouping(self.genes_, edges, self.get(algorithm=algorithm)["algorithm"]))

    def tree_grouping(self, tree: list[tuple[int, int, int]] | None = None, kmer_size: int | None = None, lower_limit: float | None = None, precluster: bool = True) -> Pangenome:
        """Bottom-up along a tree of organisms (G8); by default Ward's on distances of k-mer counts.  ``precluster``: join near-identical genes first."""
        p = self.get(kmer_size=kmer_size, lower_limit=lower_limit)
        g = self._need("sequence")
        if tree is None:
            rows = self.tree("kmer", kmer_size=p["kmer_size"]).collect()
            names = [r["org_id"] for r in self.organisms.select("org_id").orderBy("org_id").collect()]
            node = lambda v: names[v] if v < len(names) else 10**9 + v
            tree = [(node(r["left"]), node(r["right"]), 10**9 + len(names) + r["step"] - 1) for r in rows]
        near = materialize(C.precluster(g, max_length_dif=self.default("max_length_dif"), k=p["kmer_size"], dna=not self.translated), "preclusters") if precluster else None
        return self.with_groups(C.tree_grouping(g, tree, k=p["kmer_size"], lower=p["lower_limit"], preclusters=near))

    def kmer_split(self, kmer_size: int | None = None, lower_limit: float | None = None, max_length_dif: float | None = None) -> Pangenome:
        p = self.get(kmer_size=kmer_size, lower_limit=lower_limit, max_length_dif=max_length_dif)
        return self.with_groups(S.kmer_split(self._need("sequence", "group_id"), p["kmer_size"], p["lower_limit"], p["max_length_dif"]))

    def neighborhood_split(self, **how: Any) -> Pangenome:
        p = self.get(flank_size=None, force_paralogues=None, max_length_dif=None)
        named = {"flank_size": p["flank_size"], "force_paralogues": p["force_paralogues"], "max_length_dif": p["max_length_dif"], "k": self.default("kmer_size"), "limit": self.default("lower_limit")}
        return self._with(genes_=S.neighborhood_split(self._need("sequence", "group_id", *LOCATION), **named | how), group_meta=None)

    def link(self, **how: Any) -> Pangenome:
        """Paralogue links."""
        named = {"k": self.default("kmer_size"), "limit": self.default("lower_limit"), "algorithm": self.default("algorithm"), "rescale": self.default("rescale")}
        return self.add_group_info(S.paralogue_links(self._need("sequence", "group_id"), **named | how))

    def collapse(self, combine: str | Callable[[pd.DataFrame], pd.DataFrame] = "merge", sep: str | None = None) -> Pangenome:
        """Groups by paralogue link; metadata merged, of the largest group, or by a function of its rows."""
        if not self.has_paralogue_links:
            raise ValueError("paralogues are not linked")
        links = self.group_meta.select("group_id", "paralogue")
        columns = [c for c in self.group_meta.columns if c not in ("group_id", "paralogue")]
        info = M.group_info(self.genes_, self.n_organisms()).select("group_id", "n_genes").join(self.group_meta, "group_id")
        if callable(combine):
            schema = info.drop("group_id").schema
            meta = info.drop("group_id").groupBy("paralogue").applyInPandas(combine, schema).drop("n_genes")
        elif combine == "largest":
            meta = M.largest_info(info, "paralogue", "n_genes", "group_id").drop("n_genes", "group_id")
        elif combine == "merge":
            meta = M.merge_info(info, "paralogue", columns, sep)
        else:
            raise ValueError(f"unknown way to combine: {combine!r}")
        return self._with(genes_=S.collapse_paralogues(self.genes_, links), group_meta=meta.withColumnRenamed("paralogue", "group_id"))

    def add_genomes(self, new: Pangenome, *, kmer_size: int | None = None, lower_limit: float | None = None, split: bool = False, link: bool = False) -> Pangenome:
        """Grow by new organisms (M12): group them if need be, join groups whose representatives are alike, keep old group ids."""
        p = self.get(kmer_size=kmer_size, lower_limit=lower_limit)
        new = new if new.has_groups else new.tree_grouping(kmer_size=p["kmer_size"], lower_limit=p["lower_limit"])
        both = self.merge(new)
        g = both._need("sequence", "group_id")
        reps = M.representatives(g, "random").join(g.select("gene_id", "sequence"), "gene_id")
        edges = similar_pairs(reps, p["kmer_size"], p["lower_limit"])
        label = components(reps.select(F.col("gene_id").alias("node")), edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
        into = reps.join(label.withColumnRenamed("node", "gene_id"), "gene_id").select("group_id", "component")
        joined = materialize(g.join(into, "group_id").drop("group_id").withColumnRenamed("component", "group_id"), "joined")
        if split:
            joined = S.neighborhood_split(joined, k=p["kmer_size"], limit=p["lower_limit"], flank_size=self.default("flank_size"), max_length_dif=self.default("max_length_dif"))
        ids = match_groups(joined, self.genes_)
        out = both._with(genes_=materialize(joined.withColumnRenamed("group_id", "new_id").join(ids, "new_id").drop("new_id"), "grown"), group_meta=self.group_meta)
        return out.link() if link else out

    # -- analytics ---------------------------------------------------------------------------

    def org_stat(self, frequency: bool = False) -> DataFrame:
        links = self.group_meta.select("group_id", "paralogue") if self.has_paralogue_links else None
        stat = M.org_stat(self._need("sequence", "group_id"), links)
        if not frequency:
            return stat
        letters = M.residue_frequency(self.genes_)
        return stat.join(letters.groupBy("org_id").agg(F.map_from_entries(F.collect_list(F.struct("residue", "n"))).alias("residues")), "org_id")

    def group_stat(self, vicinity: int = 1) -> DataFrame:
        g = self._need("sequence", "group_id")
        stat = M.group_stat(g).join(g.groupBy("group_id").agg(F.sort_array(F.collect_list("gene_id")).alias("genes")), "group_id")
        if not self.has_location:
            return stat
        flanks = [N.flank_string("group_id", vicinity, ahead) for ahead in (False, True)]
        near = g.select("group_id", flanks[0].alias("backward"), flanks[1].alias("forward")).groupBy("group_id").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("backward", "forward")])
        return stat.join(near, "group_id")

    def pc_graph(self, slim: bool = False) -> tuple[DataFrame, DataFrame]:
        g = self._need("group_id", *LOCATION)
        return N.pc_vertices(g), N.pc_edges(g, slim)

    def neighborhood(self, group: int, vicinity: int = 4) -> DataFrame:
        return N.neighborhood(self._need("group_id", *LOCATION), group, vicinity)

    def variable_regions(self, flank_size: int | None = None) -> DataFrame:
        g = self._need("group_id", *LOCATION)
        return G.variable_regions(g.withColumn("group_id", F.col("group_id").cast("string")), self.get(flank_size=flank_size)["flank_size"])

    def plot_similarity(self, kind: str = "pangenome", ordering: str | list[int] = "auto", kmer_size: int | None = None) -> DataFrame:
        """(org1, org2, similarity, place1, place2) of all ordered pairs, ready to plot (T5).

        The order of organisms is that of the leaves of a Ward tree of sqrt(1 - similarity) ("auto"), of their ids ("none"), or given.
        """
        ids = self.organisms.select("org_id")
        a, b = ids.toDF("org_a"), ids.toDF("org_b")
        sims = self.similarity(kind, kmer_size).toDF("org_a", "org_b", "sim")
        pairs = a.crossJoin(b).filter("org_a < org_b").join(sims, ["org_a", "org_b"], "left").select("org_a", "org_b", F.coalesce("sim", F.lit(0.0)).alias("similarity"))
        names = [r["org_id"] for r in ids.orderBy("org_id").collect()]
        if ordering == "auto":
            far = pairs.select("org_a", "org_b", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("similarity"))).alias("distance"))
            merges = [(r["left"], r["right"], r["height"], r["size"]) for r in T.org_tree(ids.sparkSession, far, "ward.D2", ids).orderBy("step").collect()]
            order = [names[k] for k in T.leaf_order(merges, len(names))]
        else:
            order = names if ordering == "none" else list(ordering)
        place = ids.sparkSession.createDataFrame([(int(o), k + 1) for k, o in enumerate(order)], "org_id int, place int")
        every = pairs.union(pairs.select("org_b", "org_a", "similarity")).union(ids.select("org_id", F.col("org_id"), F.lit(1.0)))
        return every.toDF("org1", "org2", "similarity").join(F.broadcast(place.toDF("org1", "place1")), "org1").join(F.broadcast(place.toDF("org2", "place2")), "org2")

    def plot_tree(self, kind: str = "pangenome", dist: str = "euclidean", clust: str = "ward.D2", info: str | None = None, circular: bool = False, kmer_size: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Segments (x, y, xend, yend) of the organisms' dendrogram, and its leaves (x, org_id, org_name, and the ``info`` column) (T6); ``circular`` turns heights inward."""
        spark = self.genes_.sparkSession
        if info is not None and info not in self.organisms.columns:
            raise ValueError(f"organisms have no {info!r}")
        rows = self.tree(kind, dist, clust, kmer_size).orderBy("step").collect()
        names = [r["org_id"] for r in self.organisms.select("org_id").orderBy("org_id").collect()]
        merges = [(r["left"], r["right"], r["height"], r["size"]) for r in rows]
        order, segments = T.leaf_order(merges, len(names)), T.segments(merges, len(names))
        turn = -1.0 if circular else 1.0
        lines = spark.createDataFrame([(x, turn * y, u, turn * v) for x, y, u, v in segments], "x double, y double, xend double, yend double")
        leaves = spark.createDataFrame([(int(names[leaf]), float(k + 1)) for k, leaf in enumerate(order)], "org_id int, x double")
        return lines, leaves.join(self.organisms.select("org_id", "org_name", *([info] if info else [])), "org_id")

    def similarity(self, kind: str = "pangenome", kmer_size: int | None = None) -> DataFrame:
        """(i, j, sim) of organisms (T5)."""
        if kind == "kmer":
            return org_kmer_similarity(self._need("sequence"), self.get(kmer_size=kmer_size)["kmer_size"])
        return M.org_similarity(self._need("group_id")).toDF("i", "j", "sim")

    def tree(self, kind: str = "pangenome", dist: str = "euclidean", clust: str = "ward.D2", kmer_size: int | None = None) -> DataFrame:
        """Merge table of the organisms (T1) from distances of gene groups, or of k-mers (also "cosine")."""
        ids = self.organisms.select("org_id")
        if kind == "kmer":
            distance = org_kmer_distance(self._need("sequence"), ids, self.get(kmer_size=kmer_size)["kmer_size"], dist)
        else:
            distance = M.org_distance(self._need("group_id"), dist)
        return T.org_tree(self.genes_.sparkSession, distance, clust, ids)

    def plot_stat(self, sort: bool = True) -> DataFrame:
        """Genes of each organism by class of their groups, ready to plot."""
        info = self.group_info().select("group_id", "class")
        out = self.genes_.join(info, "group_id").groupBy("org_id", "class").agg(F.count("*").alias("n")).join(self.organisms.select("org_id", "org_name", "n_genes"), "org_id")
        return out.orderBy(F.col("n_genes").desc(), "org_id") if sort else out

    def plot_evolution(self, ordering: str | list[int] = "bootstrap", times: int = 10, seed: int = 1) -> DataFrame:
        """Class counts as organisms come in (T4)."""
        g, t = self._need("group_id"), self.default("core_threshold")
        if ordering == "bootstrap":
            return M.evolution_bootstrap(g, self.n_organisms(), self.organisms.select("org_id"), t, times, seed)
        if isinstance(ordering, list):
            order = self.genes_.sparkSession.createDataFrame([(int(o), k + 1) for k, o in enumerate(ordering)], "org_id int, pos int")
        else:
            by = F.xxhash64("org_id", F.lit(seed)) if ordering == "random" else F.col("org_id")
            order = self.organisms.select("org_id", F.row_number().over(W.orderBy(by)).alias("pos"))
        return M.evolution(g, order, t)

    def plot_group(self, group: int) -> DataFrame:
        """Similarities within a group, widths scaled to 1..5."""
        p = self.get(kmer_size=None, lower_limit=None, rescale=None, transform=None)
        own = self._need("sequence", "group_id").filter(F.col("group_id") == group)
        return M.scale_range(transform_sim(similar_pairs(own, p["kmer_size"], p["lower_limit"]), p["lower_limit"], p["rescale"], p["transform"]).withColumn("edge_width", F.col("sim")), "edge_width", 1, 5)
