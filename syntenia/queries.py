"""The engine's operators as queries over the driver tables, and the equivalent SQL.

Stand-ins: organism = supplier nation; gene = line item, group = part (or order); contig =
user with events in time order, group = event type and value band, strand = parity of the
event id; sequence = document text, organism = source, group = language.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kmers as K
from .functions import pairs as P
from .operators import clustering as C
from .operators import graph as G
from .operators import matrix as M
from .operators import neighbors as N
from .operators import splitting as S
from .operators import tree as T
from .pangenome import Pangenome, group_changes, match_groups, report_changes

N_ORGS, CORE = 25, 0.8


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str, group: str = "l_partkey") -> DataFrame:
    """genes(gene_id, org_id, group_id) of line items."""
    line = _t(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gene_id"), F.col(group).alias("group_id"), "l_suppkey")
    nation = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("org_id"))
    return line.join(nation, "l_suppkey").drop("l_suppkey")


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """genes with location, of events: one contig per user, groups of type and value band."""
    band = F.floor(F.col("value") / 20).cast("long")
    return _t(spark, d, "events").select(
        F.col("event_id").alias("gene_id"), (F.col("user_id") % 7).alias("org_id"), F.col("user_id").alias("contig"), F.concat_ws("_", "event_type", band.cast("string")).alias("group_id"), F.col("ts").alias("start"), F.col("ts").alias("end"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(1).alias("width")
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """genes with sequence, of documents."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("gene_id"), F.col("source").alias("org_id"), F.col("lang").alias("group_id"), F.col("text").alias("sequence"), F.length("text").cast("long").alias("width"), F.concat_ws("/", "source", "lang").alias("block"))


def _r(c, n: int = 9):
    return F.round(c, n)


def _orgs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("org_id"), (F.col("n_nationkey") + 1).alias("pos"))


def _band_pairs(s: SparkSession, d: str) -> DataFrame:
    g = _t(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("group_id"), F.col("p_retailprice").alias("width"))
    return S.band_pairs(g, 0.001).select("group_id", "i", "j")


def _width_components(s: SparkSession, d: str) -> DataFrame:
    g = _t(s, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("group_id"), F.col("p_retailprice").alias("width"))
    return S.width_components(g, 0.001)


def pangenome(s: SparkSession, d: str) -> Pangenome:
    """The events as an object of seven organisms; groups by type and value band, names that repeat."""
    group = F.ascii("event_type").cast("long") * 100 + F.floor(F.col("value") / 20).cast("long")
    genes = _t(s, d, "events").select(F.col("event_id").alias("gene_id"), (F.col("user_id") % 7).alias("org_id"), group.alias("group_id"), F.concat(F.lit("gene_"), (F.col("event_id") % 100).cast("string")).alias("desc"))
    return Pangenome(genes, _t(s, d, "nation").filter("n_nationkey < 7").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org_name"), F.lit(0).alias("n_genes")))


def _by_group(pg: Pangenome) -> DataFrame:
    """Groups, organisms and genes after a change of the object, by their new numbers."""
    return pg.genes_.groupBy("group_id").agg(F.count("*").alias("n_genes"), F.min("org_id").alias("first_org"), F.max("org_id").alias("last_org"), F.min("gene_id").alias("first_gene"))


def said(s: SparkSession, d: str) -> DataFrame:
    """genes with sequence, of conversations' turns."""
    return _t(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("gene_id"), F.col("role").alias("group_id"), F.col("text").alias("sequence"), F.length("text").cast("long").alias("width"))


def _kmer_split(s: SparkSession, d: str) -> DataFrame:
    """Genes and the smallest gene of their new group."""
    g = said(s, d)
    found = S.kmer_split(g, 5, 0.8, 0.2)
    return found.join(found.groupBy("group_id").agg(F.min("gene_id").alias("first_gene")), "group_id").select("gene_id", "first_gene")


def _cliques(s: SparkSession, d: str) -> DataFrame:
    """Cliques of turns of one role that are alike, the best edges first."""
    g = said(s, d)
    sims = P.similar_pairs(g, 5, 0.3, "group_id")
    edges = sims.select("i", "j", F.round(F.col("sim") * 10).cast("long").alias("n_sim"), _r(F.col("sim")).alias("s_sim"), F.lit(0).alias("g_sim"))
    return S.cliques(g, edges)


def _remove(s: SparkSession, d: str) -> DataFrame:
    """Genes without those of one organism and one group; groups renumbered densely."""
    g = parts(s, d).filter("org_id <> 3 AND group_id <> 7")
    return M.renumber(g, "group_id").groupBy("group_id").agg(F.count("*").alias("n_genes"), F.min("gene_id").alias("first_gene"))


def _subset(s: SparkSession, d: str) -> DataFrame:
    keep = _t(s, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("org_id"))
    return M.pan_matrix(M.renumber(parts(s, d).join(F.broadcast(keep), "org_id", "left_semi"), "org_id"))


def _annot(s: SparkSession, d: str) -> DataFrame:
    """Conversations as an annotation file: name, annotation, description."""
    from .sources.annotation import collect_annotation

    rows = _t(s, d, "conversations").select(F.col("conv_id").cast("string").alias("name"), F.concat(F.when(F.col("role") == "user", "GO:").otherwise("EC:"), F.col("turn").cast("string")).alias("annot"), F.col("text").alias("desc"), F.col("turn").alias("line"))
    found = collect_annotation(rows)
    return found.select("name", "description", F.array_join(F.sort_array("GO"), ";").alias("go"), F.array_join(F.sort_array("EC"), ";").alias("ec"))


def _collapse(s: SparkSession, d: str) -> DataFrame:
    links = M.renumber(_t(s, d, "part").select(F.col("p_partkey").alias("group_id"), F.col("p_brand").alias("paralogue")), "paralogue")
    return M.group_info(S.collapse_paralogues(parts(s, d), links), N_ORGS, CORE)


def _merge_info(s: SparkSession, d: str) -> DataFrame:
    return M.merge_info(_t(s, d, "part"), "p_brand", ["p_type", "p_size"], sep=";")


def _largest(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_name")
    return M.largest_info(p, "p_brand", "p_size", "p_partkey")


def _components(s: SparkSession, d: str) -> DataFrame:
    """Components of the graph of customers who bought the same part."""
    from .operators.components import components

    o = _t(s, d, "orders").select("o_orderkey", "o_custkey")
    line = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    edges = o.join(line, "o_orderkey").select(F.col("o_custkey").alias("u"), (-F.col("l_partkey")).alias("v")).distinct()
    return components(edges.select(F.col("u").alias("node")).distinct(), edges).groupBy("component").agg(F.count("*").alias("n"))


def _match(s: SparkSession, d: str) -> DataFrame:
    old = parts(s, d).select("gene_id", "group_id")
    new = parts(s, d).select("gene_id", (F.col("group_id") % 500).alias("group_id"))
    return match_groups(new, old)


def _renumber(s: SparkSession, d: str) -> DataFrame:
    """Orders' keys, which have gaps, numbered densely."""
    return M.renumber(parts(s, d, "l_orderkey").select("gene_id", "group_id"), "group_id")


def _changes(s: SparkSession, d: str) -> DataFrame:
    """Genes that moved, came or went between two groupings of overlapping gene sets."""
    old = parts(s, d).filter("org_id <> 3").select("gene_id", "group_id")
    new = parts(s, d).filter("org_id <> 5").select("gene_id", (F.col("group_id") % 500).alias("group_id"))
    return group_changes(new, old)


def _merged(s: SparkSession, d: str) -> DataFrame:
    """A pangenome merged with itself: every id of the second copy lies after the first's."""
    one = Pangenome(parts(s, d), _t(s, d, "nation").select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("org_name")))
    return one.merge(one).genes_.groupBy("org_id").agg(F.count("*").alias("n_genes"), F.min("gene_id").alias("first_gene"), F.max("group_id").alias("last_group"))


def _leaders(s: SparkSession, d: str) -> DataFrame:
    return C.leader_clusters(texts(s, d), 5, 0.9, kind="group_id")


def _variable(s: SparkSession, d: str) -> DataFrame:
    return G.variable_regions(contigs(s, d), 2).select(F.array_join("members", ";").alias("members"), F.array_join("flank", ";").alias("flank"), "type")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return T.org_tree(s, M.org_distance(parts(s, d)), "ward.D2")


def _links(s: SparkSession, d: str) -> DataFrame:
    g = texts(s, d).withColumn("group_id", F.concat_ws("/", "org_id", "group_id"))
    return S.paralogue_links(g, 4, 0.9)


_DISTANCES = ("euclidean", "manhattan", "maximum", "canberra", "binary", "minkowski")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "core_accessory_singleton": lambda s, d: M.group_info(parts(s, d), N_ORGS, CORE).groupBy("class").agg(F.count("*").alias("n_groups")),
    "core_accessory_by_order": lambda s, d: M.group_info(parts(s, d, "l_orderkey"), N_ORGS, CORE).groupBy("class").agg(F.count("*").alias("n_groups")),
    "pg_matrix_long": lambda s, d: M.pan_matrix(parts(s, d)),
    "pg_matrix_pivot": lambda s, d: M.pan_pivot(parts(s, d), list(range(N_ORGS))),
    "group_info": lambda s, d: M.group_info(parts(s, d), N_ORGS, CORE),
    "class_percent": lambda s, d: M.class_percent(M.group_info(parts(s, d, "l_orderkey"), N_ORGS, CORE)).withColumn("percent", _r(F.col("percent"))),
    "has_paralogues": lambda s, d: M.with_paralogues(parts(s, d, "l_orderkey")),
    "org_n_paralogues": lambda s, d: M.paralogue_counts(parts(s, d)),
    "pan_groups": lambda s, d: M.pan_groups(parts(s, d), N_ORGS, CORE),
    "evolution_ordered": lambda s, d: M.evolution(parts(s, d), _orgs(s, d), CORE),
    "evolution_bootstrap": lambda s, d: M.evolution_bootstrap(parts(s, d), N_ORGS, _orgs(s, d).select("org_id"), CORE),
    "org_jaccard": lambda s, d: M.org_similarity(parts(s, d)).withColumn("jaccard", _r(F.col("jaccard"))),
    **{f"org_dist_{m}": (lambda m: lambda s, d: M.org_distance(parts(s, d), m, 3.0).withColumn("distance", _r(F.col("distance"), 6)))(m) for m in _DISTANCES},
    "org_stat": lambda s, d: M.org_stat(texts(s, d)).withColumn("sd_length", _r(F.col("sd_length"), 6)),
    "group_stat": lambda s, d: M.group_stat(texts(s, d)).withColumn("sd_length", _r(F.col("sd_length"), 6)),
    "residue_frequency": lambda s, d: M.residue_frequency(texts(s, d)),
    "gene_width": lambda s, d: texts(s, d).select("gene_id", "width"),
    "rep_longest": lambda s, d: M.representatives(texts(s, d), "longest"),
    "rep_shortest": lambda s, d: M.representatives(texts(s, d), "shortest"),
    "rep_random": lambda s, d: M.representatives(parts(s, d), "random"),
    "scaled_prices": lambda s, d: M.scale_range(_t(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1, 5).withColumn("p_retailprice", _r(F.col("p_retailprice"), 6)),
    "neighbors": lambda s, d: N.neighbors(contigs(s, d)),
    "neighbors_strand": lambda s, d: N.neighbors(contigs(s, d), "group_id", stranded=True),
    "flank_string": lambda s, d: contigs(s, d).select("gene_id", N.flank_string("group_id", 3).alias("forward"), N.flank_string("group_id", 3, False).alias("backward"), N.flank_string("group_id", 1).alias("next")),
    "group_neighbors": lambda s, d: N.group_neighbors(contigs(s, d)),
    "trails": lambda s, d: N.trails(contigs(s, d), 2).select("gene_id", F.array_join("trail", ";").alias("trail")),
    "trail_edges": lambda s, d: N.trail_edges(N.trails(contigs(s, d), 2)),
    "neighborhood": lambda s, d: N.neighborhood(contigs(s, d), "click_1", 2),
    "pc_edges_slim": lambda s, d: N.pc_edges(contigs(s, d), slim=True),
    "pc_edges_weighted": lambda s, d: N.pc_edges(contigs(s, d)),
    "pc_vertices": lambda s, d: N.pc_vertices(contigs(s, d)).select("group_id", *[F.array_join(c, ";").alias(c) for c in ("organisms", "upstream", "downstream")]),
    "pc_degree": lambda s, d: N.degrees(N.pc_edges(contigs(s, d), slim=True)),
    "neighborhood_similarity": lambda s, d: S.neighborhood_similarity(contigs(s, d), 2),
    "kmer_spectrum": lambda s, d: K.kmers(texts(s, d), 5),
    "org_kmer_cosine": lambda s, d: K.org_kmer_similarity(texts(s, d), 4).withColumn("sim", _r(F.col("sim"))),
    "kmer_cosine_pairs": lambda s, d: P.cosine_of_genes(texts(s, d), 5, 0.9, "group_id").withColumn("sim", _r(F.col("sim"))),
    "rescaled_sim": lambda s, d: K.transform_sim(P.cosine_of_genes(texts(s, d), 5, 0.9, "group_id"), 0.9, True, lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))).withColumn("sim", _r(F.col("sim"), 6)),
    "kmer_split": _kmer_split,
    "identity_clusters": lambda s, d: C.identity_clusters(said(s, d), C.IdentityOptions(c=0.9, s=0.8)),
    "remove_organisms": lambda s, d: _by_group(pangenome(s, d).remove_genes(organisms=[3, 4])),
    "remove_groups": lambda s, d: _by_group(pangenome(s, d).remove_genes(groups=[10100, 9901, 9901])),
    "remove_names": lambda s, d: _by_group(pangenome(s, d).remove_genes(names=["gene_9", "gene_17"])),
    "remove_names_of_organisms": lambda s, d: _by_group(pangenome(s, d).remove_genes(names=["gene_9", "gene_17", "gene_18"], organisms=["NATION_1", "NATION_2", "NATION_3"])),
    "remove_places": lambda s, d: _by_group(pangenome(s, d).remove_genes(groups=[10100, 9901], ind=[1, 3])),
    "cliques": _cliques,
    "all_groups": lambda s, d: pangenome(s, d).all_groups().select("group_id", "n_org", "n_genes"),
    "group_lists": lambda s, d: M.group_lists(pangenome(s, d).genes_).select("group_id", F.array_join(F.transform("genes", lambda g: g.cast("string")), ",").alias("genes")),
    "plot_stat": lambda s, d: pangenome(s, d).set_defaults(core_threshold=0.8).plot_stat(False).select("org_id", "class", "n", "org_name"),
    "subset_object": lambda s, d: _by_group(pangenome(s, d).subset([5, 1, 2])),
    "linked_paralogues": lambda s, d: M.paralogue_counts(parts(s, d), M.renumber(_t(s, d, "part").select(F.col("p_partkey").alias("group_id"), F.col("p_brand").alias("paralogue")), "paralogue")),
    "org_graphs": lambda s, d: N.org_graphs(contigs(s, d)),
    "ego_graph": lambda s, d: N.ego(N.pc_edges(contigs(s, d), slim=True), contigs(s, d).select("group_id").distinct(), 2),
    "report_changes": lambda s, d: report_changes(pangenome(s, d).genes_.select("gene_id", (F.col("group_id") % 1000).alias("group_id")), pangenome(s, d).genes_.select("gene_id", "group_id")),
    "length_band_pairs": _band_pairs,
    "width_components": _width_components,
    "remove_genes": _remove,
    "subset_orgs": _subset,
    "merge_info": _merge_info,
    "largest_info": _largest,
    "collapse_paralogues": _collapse,
    "read_annot": _annot,
    "components": _components,
    "match_groups": _match,
    "group_changes": _changes,
    "renumber": _renumber,
    "merge_pangenomes": _merged,
    "leader_clusters": _leaders,
    "variable_regions": _variable,
    "org_tree": _tree,
    "paralogue_links": _links,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


_GENES = "SELECT l_orderkey * 8 + l_linenumber AS gene_id, {g} AS group_id, s_nationkey AS org_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
_PARTS, _BY_ORDER = _GENES.format(g="l_partkey"), _GENES.format(g="l_orderkey")
_TEXTS = "SELECT doc_id AS gene_id, source AS org_id, lang AS group_id, text AS sequence, length(text) AS width, source || '/' || lang AS block FROM documents"
_CONTIGS = "SELECT event_id AS gene_id, user_id % 7 AS org_id, user_id AS contig, event_type || '_' || floor(value / 20)::BIGINT AS group_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM events"
_WIN = "PARTITION BY org_id, contig ORDER BY ts, gene_id"
_INFO = "SELECT group_id, count(DISTINCT org_id) AS n_org, count(*) AS n_genes, CASE WHEN count(DISTINCT org_id) / 25.0 >= 0.8 THEN 'Core' WHEN count(DISTINCT org_id) = 1 THEN 'Singleton' ELSE 'Accessory' END AS class FROM g GROUP BY 1"
_TRAIL = f"""w AS (SELECT gene_id, group_id, strand, list(group_id) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM g),
t AS (SELECT gene_id, group_id, CASE WHEN strand = -1 THEN list_reverse(l) ELSE l END AS trail FROM w)"""
_FLANK = "concat_ws(';', {}) AS {}"
_PAIR_DIST = """WITH g AS ({g}), m AS (SELECT org_id, group_id, count(*) AS n FROM g GROUP BY ALL), o AS (SELECT DISTINCT org_id FROM m), a AS (SELECT DISTINCT group_id FROM m),
f AS (SELECT o.org_id, a.group_id, coalesce(n, 0) AS n FROM o CROSS JOIN a LEFT JOIN m ON m.org_id = o.org_id AND m.group_id = a.group_id)
SELECT x.org_id AS org_a, y.org_id AS org_b, round({e}, 6) AS distance FROM f x JOIN f y ON x.group_id = y.group_id AND x.org_id < y.org_id GROUP BY 1, 2"""
_EXPR = {
    "euclidean": "sqrt(sum((x.n - y.n) ** 2)::DOUBLE)",
    "manhattan": "sum(abs(x.n - y.n))::DOUBLE",
    "maximum": "max(abs(x.n - y.n))::DOUBLE",
    "canberra": "sum(CASE WHEN x.n + y.n > 0 THEN abs(x.n - y.n)::DOUBLE / (x.n + y.n) END) * count(*) / count(CASE WHEN x.n + y.n > 0 THEN 1 END)",
    "binary": "count(CASE WHEN (x.n > 0) <> (y.n > 0) THEN 1 END)::DOUBLE / count(CASE WHEN x.n + y.n > 0 THEN 1 END)",
    "minkowski": "pow(sum(pow(abs(x.n - y.n)::DOUBLE, 3.0)), 1.0 / 3.0)",
}
_KMERS = "SELECT {key}, substr(sequence, i, {k}) AS kmer, count(*) AS n FROM (SELECT {key}, sequence, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM g WHERE length(sequence) >= {k}) GROUP BY ALL"
_COSINE = """WITH g AS ({g}), k AS ({kmers}), w AS (SELECT {key} AS id, {block} AS block, kmer, n / sqrt(sum(n * n) OVER (PARTITION BY {key})::DOUBLE) AS w FROM k)
SELECT a.id AS i, b.id AS j, {sim} AS sim FROM w a JOIN w b ON a.kmer = b.kmer AND a.block = b.block AND a.id < b.id GROUP BY 1, 2 {having}"""
_OBJECT = "SELECT event_id AS gene_id, user_id % 7 AS org_id, ascii(event_type) * 100 + floor(value / 20)::BIGINT AS group_id FROM events"
_SAID = "SELECT conv_id * 100 + turn AS gene_id, role AS group_id, text AS sequence, length(text) AS width FROM conversations"


def _changed(keep: str) -> str:
    """Groups after a change of the object that keeps the genes of a condition: every number dense anew."""
    return f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY gene_id) AS place FROM ({_OBJECT})), g AS (SELECT * FROM p WHERE {keep}),
      n AS (SELECT dense_rank() OVER (ORDER BY org_id) AS org_id, dense_rank() OVER (ORDER BY group_id) AS group_id, dense_rank() OVER (ORDER BY gene_id) AS gene_id FROM g)
      SELECT group_id, count(*) AS n_genes, min(org_id) AS first_org, max(org_id) AS last_org, min(gene_id) AS first_gene FROM n GROUP BY 1"""


_COUNTS = "count(CASE WHEN n = 1 THEN 1 END) AS singleton, count(CASE WHEN n > 1 AND n / {k} < 0.8 THEN 1 END) AS accessory, count(CASE WHEN n / {k} >= 0.8 THEN 1 END) AS core, count(*) AS total"


def oracle_sql() -> dict[str, str]:
    pairs = f"WITH g AS ({_CONTIGS}), p AS (SELECT org_id, group_id AS x, lead(group_id) OVER ({_WIN}) AS y FROM g), e AS (SELECT least(x, y) AS a, greatest(x, y) AS b, org_id FROM p WHERE y IS NOT NULL)"
    lags = lambda f: ", ".join(f"coalesce({f}(group_id, {k}) OVER ({_WIN}), 'NA')" for k in (1, 2, 3))
    stat = "SELECT {k}, count(*) AS n_genes, min(width) AS min_length, max(width) AS max_length, round(stddev_samp(width), 6) AS sd_length FROM g GROUP BY 1"
    flank = f"""g AS ({_CONTIGS}),
    v AS (SELECT gene_id, org_id, group_id, strand, coalesce(list(group_id) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS b, coalesce(list(group_id) OVER ({_WIN} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS a FROM g),
    f AS (SELECT gene_id, org_id, group_id, CASE WHEN strand = -1 THEN a || list_reverse(b) ELSE list_reverse(b) || a END AS flank FROM v),
    p AS (SELECT x.group_id, x.gene_id AS i, y.gene_id AS j, list_filter(x.flank, lambda e: list_contains(y.flank, e)) AS fi, list_filter(y.flank, lambda e: list_contains(x.flank, e)) AS fj
          FROM f x JOIN f y ON x.group_id = y.group_id AND x.gene_id < y.gene_id AND x.org_id <> y.org_id)"""
    return {
        "core_accessory_singleton": f"WITH g AS ({_PARTS}) SELECT class, count(*) AS n_groups FROM ({_INFO}) GROUP BY 1",
        "core_accessory_by_order": f"WITH g AS ({_BY_ORDER}) SELECT class, count(*) AS n_groups FROM ({_INFO}) GROUP BY 1",
        "pg_matrix_long": f"WITH g AS ({_PARTS}) SELECT group_id, org_id, count(*) AS n FROM g GROUP BY ALL",
        "pg_matrix_pivot": f"WITH g AS ({_PARTS}) SELECT group_id, " + ", ".join(f"count(CASE WHEN org_id = {o} THEN 1 END) AS org_{o}" for o in range(N_ORGS)) + " FROM g GROUP BY 1",
        "group_info": f"WITH g AS ({_PARTS}) {_INFO}",
        "class_percent": f"WITH g AS ({_BY_ORDER}) SELECT class, count(*) AS n_groups, round(count(*) * 100.0 / sum(count(*)) OVER (), 9)::DOUBLE AS percent FROM ({_INFO}) GROUP BY 1",
        "has_paralogues": f"WITH g AS ({_BY_ORDER}) SELECT group_id, count(*) > count(DISTINCT org_id) AS has_paralogues FROM g GROUP BY 1",
        "org_n_paralogues": f"WITH g AS ({_PARTS}), m AS (SELECT group_id, org_id, count(*) AS n FROM g GROUP BY ALL) SELECT org_id, count(*) AS n_gene_groups, count(CASE WHEN n > 1 THEN 1 END) AS n_paralogues FROM m GROUP BY 1",
        "pan_groups": f"WITH g AS ({_PARTS}), m AS (SELECT group_id, count(DISTINCT org_id) AS n FROM g GROUP BY 1) SELECT {_COUNTS.format(k='25.0')} FROM m",
        "evolution_ordered": f"WITH g AS ({_PARTS}), o AS (SELECT n_nationkey + 1 AS k FROM nation), m AS (SELECT k, group_id, count(DISTINCT org_id) AS n FROM g JOIN o ON org_id + 1 <= k GROUP BY ALL) SELECT k, {_COUNTS.format(k='k::DOUBLE')} FROM m GROUP BY 1",
        "org_jaccard": f"WITH g AS ({_PARTS}), d AS (SELECT DISTINCT org_id, group_id FROM g), s AS (SELECT org_id, count(*) AS c FROM d GROUP BY 1), b AS (SELECT x.org_id AS org_a, y.org_id AS org_b, count(*) AS c FROM d x JOIN d y ON x.group_id = y.group_id AND x.org_id < y.org_id GROUP BY 1, 2) SELECT p.org_id AS org_a, q.org_id AS org_b, round(coalesce(b.c, 0)::DOUBLE / (p.c + q.c - coalesce(b.c, 0)), 9) AS jaccard FROM s p JOIN s q ON p.org_id < q.org_id LEFT JOIN b ON org_a = p.org_id AND org_b = q.org_id",
        **{f"org_dist_{m}": _PAIR_DIST.format(g=_PARTS, e=e) for m, e in _EXPR.items()},
        "org_stat": f"WITH g AS ({_TEXTS}), m AS (SELECT org_id, group_id, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT org_id, count(*) AS n_gene_groups, count(CASE WHEN n > 1 THEN 1 END) AS n_paralogues FROM m GROUP BY 1) SELECT * FROM ({stat.format(k='org_id')}) JOIN p USING (org_id)",
        "group_stat": f"WITH g AS ({_TEXTS}), m AS (SELECT org_id, group_id, count(*) AS n FROM g GROUP BY ALL), p AS (SELECT group_id, max(n) AS max_org FROM m GROUP BY 1) SELECT * FROM ({stat.format(k='group_id')}) JOIN p USING (group_id)",
        "residue_frequency": f"WITH g AS ({_TEXTS}) SELECT org_id, residue, count(*) AS n FROM (SELECT org_id, unnest(string_split(sequence, '')) AS residue FROM g) WHERE residue <> '' GROUP BY ALL",
        "gene_width": f"SELECT gene_id, width FROM ({_TEXTS})",
        "rep_longest": f"SELECT group_id, gene_id, width FROM ({_TEXTS}) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY width DESC, gene_id) = 1",
        "rep_shortest": f"SELECT group_id, gene_id, width FROM ({_TEXTS}) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY width, gene_id) = 1",
        "rep_random": f"SELECT group_id, gene_id FROM ({_PARTS}) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY md5(gene_id::VARCHAR || ':0'), gene_id) = 1",
        "scaled_prices": "SELECT p_partkey, round(1 + (p_retailprice - min(p_retailprice) OVER ()) * 4 / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part",
        "neighbors": f"SELECT gene_id, lag(gene_id) OVER ({_WIN}) AS down, lead(gene_id) OVER ({_WIN}) AS up, strand = -1 AS reverse FROM ({_CONTIGS})",
        "neighbors_strand": f"WITH n AS (SELECT gene_id, strand, lag(group_id) OVER ({_WIN}) AS b, lead(group_id) OVER ({_WIN}) AS a FROM ({_CONTIGS})) SELECT gene_id, CASE WHEN strand = -1 THEN a ELSE b END AS down, CASE WHEN strand = -1 THEN b ELSE a END AS up, strand = -1 AS reverse FROM n",
        "flank_string": f"SELECT gene_id, {_FLANK.format(lags('lead'), 'forward')}, {_FLANK.format(lags('lag'), 'backward')}, lead(group_id) OVER ({_WIN}) AS next FROM ({_CONTIGS})",
        "trails": f"WITH g AS ({_CONTIGS}), {_TRAIL} SELECT gene_id, array_to_string(trail, ';') AS trail FROM t",
        "trail_edges": f'WITH g AS ({_CONTIGS}), {_TRAIL}, e AS (SELECT unnest(list_zip(trail[:-2], trail[2:])) AS p FROM t) SELECT p[1] AS "from", p[2] AS "to", count(*) AS n FROM e GROUP BY 1, 2',
        "neighborhood": f"""WITH g AS ({_CONTIGS}), {_TRAIL}, e AS (SELECT unnest(list_zip(trail[:-2], trail[2:])) AS p FROM t WHERE group_id = 'click_1')
          SELECT p[1] AS "from", p[2] AS "to", count(*) AS n, p[1] = 'click_1' AS from_center, p[2] = 'click_1' AS to_center FROM e GROUP BY ALL""",
        "pc_edges_slim": f"{pairs} SELECT DISTINCT a, b FROM e",
        "pc_edges_weighted": f"{pairs} SELECT a, b, count(*) AS weight, array_to_string(list_sort(list(DISTINCT org_id)), ';') AS organisms FROM e GROUP BY 1, 2",
        "pc_vertices": f"""WITH g AS ({_CONTIGS}), n AS (SELECT group_id, org_id, strand, lag(group_id) OVER ({_WIN}) AS b, lead(group_id) OVER ({_WIN}) AS a FROM g),
          m AS (SELECT group_id, org_id, CASE WHEN strand = -1 THEN b ELSE a END AS up, CASE WHEN strand = -1 THEN a ELSE b END AS down FROM n)
          SELECT group_id, array_to_string(list_sort(list(DISTINCT org_id)), ';') AS organisms, coalesce(array_to_string(list_sort(list(DISTINCT up) FILTER (up IS NOT NULL)), ';'), '') AS upstream, coalesce(array_to_string(list_sort(list(DISTINCT down) FILTER (down IS NOT NULL)), ';'), '') AS downstream FROM m GROUP BY 1""",
        "pc_degree": f"{pairs}, d AS (SELECT DISTINCT a, b FROM e), n AS (SELECT a AS group_id FROM d UNION ALL SELECT b FROM d) SELECT group_id, count(*) AS degree FROM n GROUP BY 1",
        "neighborhood_similarity": f"WITH {flank}, q AS (SELECT group_id, i, j, len(list_filter(list_zip(fi, fj), lambda e: coalesce(e[1] = e[2], false)))::INT AS n_sim FROM p) SELECT * FROM q WHERE n_sim > 0",
        "kmer_spectrum": f"WITH g AS ({_TEXTS}) {_KMERS.format(key='gene_id', k=5)}",
        "org_kmer_cosine": _COSINE.format(g=_TEXTS, kmers=_KMERS.format(key="org_id", k=4), key="org_id", block="0", sim="round(greatest(sum(a.w * b.w), 0), 9)", having=""),
        "kmer_cosine_pairs": _COSINE.format(g=_TEXTS, kmers=_KMERS.format(key="gene_id", k=5), key="gene_id", block="0", sim="round(sum(a.w * b.w), 9)", having="HAVING sum(a.w * b.w) >= 0.9 - 1e-12"),
        "rescaled_sim": _COSINE.format(g=_TEXTS, kmers=_KMERS.format(key="gene_id", k=5), key="gene_id", block="0", sim="round(sqrt(greatest((sum(a.w * b.w) - 0.9) / (1.0 - 0.9), 0)), 6)", having="HAVING sum(a.w * b.w) >= 0.9 - 1e-12"),
        "length_band_pairs": "SELECT x.p_brand AS group_id, x.p_partkey AS i, y.p_partkey AS j FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey WHERE abs(x.p_retailprice - y.p_retailprice) / least(x.p_retailprice, y.p_retailprice) <= 0.001",
        "width_components": """WITH o AS (SELECT p_partkey, p_brand, p_retailprice AS v, lag(p_retailprice) OVER w AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
          r AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND (v - b) / b <= 0.001 THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY v, p_partkey) AS run FROM o)
          SELECT p_partkey AS gene_id, min(p_partkey) OVER (PARTITION BY p_brand, run) AS component FROM r""",
        "remove_genes": f"WITH g AS (SELECT gene_id, dense_rank() OVER (ORDER BY group_id) AS group_id FROM ({_PARTS}) WHERE org_id <> 3 AND group_id <> 7) SELECT group_id, count(*) AS n_genes, min(gene_id) AS first_gene FROM g GROUP BY 1",
        "subset_orgs": f"WITH g AS (SELECT group_id, dense_rank() OVER (ORDER BY org_id) AS org_id FROM ({_PARTS}) WHERE org_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) SELECT group_id, org_id, count(*) AS n FROM g GROUP BY ALL",
        "renumber": f"SELECT gene_id, dense_rank() OVER (ORDER BY group_id) AS group_id FROM ({_BY_ORDER})",
        "remove_organisms": _changed("org_id NOT IN (3, 4)"),
        "remove_groups": _changed("group_id NOT IN (10100, 9901)"),
        "remove_names": _changed("gene_id % 100 NOT IN (9, 17)"),
        "remove_names_of_organisms": _changed("NOT ((gene_id % 100 = 9 AND org_id = 1) OR (gene_id % 100 = 17 AND org_id = 2) OR (gene_id % 100 = 18 AND org_id = 3))"),
        "remove_places": _changed("NOT ((group_id = 10100 AND place = 1) OR (group_id = 9901 AND place = 3))"),
        "all_groups": f"WITH g AS ({_OBJECT}), i AS (SELECT group_id, count(DISTINCT org_id) AS n_org, count(*) AS n_genes FROM g GROUP BY 1) SELECT r.group_id, coalesce(n_org, 0) AS n_org, coalesce(n_genes, 0) AS n_genes FROM range(1, (SELECT max(group_id) + 1 FROM g)) r(group_id) LEFT JOIN i USING (group_id)",
        "group_lists": f"SELECT group_id, string_agg(gene_id::VARCHAR, ',' ORDER BY gene_id) AS genes FROM ({_OBJECT}) GROUP BY 1",
        "plot_stat": f"""WITH g AS ({_OBJECT}), i AS (SELECT group_id, CASE WHEN count(DISTINCT org_id) / 7.0 >= 0.8 THEN 'Core' WHEN count(DISTINCT org_id) = 1 THEN 'Singleton' ELSE 'Accessory' END AS class FROM g GROUP BY 1)
          SELECT org_id, class, count(*) AS n, n_name AS org_name FROM g JOIN i USING (group_id) JOIN nation ON n_nationkey = org_id GROUP BY ALL""",
        "subset_object": _changed("org_id IN (1, 2, 5)"),
        "linked_paralogues": f"""WITH l AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS link FROM part), m AS (SELECT org_id, link, count(*) AS n, count(DISTINCT group_id) AS k FROM ({_PARTS}) JOIN l ON group_id = p_partkey GROUP BY 1, 2)
          SELECT org_id, sum(k)::BIGINT AS n_gene_groups, count(CASE WHEN n > 1 THEN 1 END) AS n_paralogues FROM m GROUP BY 1""",
        "org_graphs": f"{pairs} SELECT org_id, a, b, count(*) AS weight FROM e GROUP BY ALL",
        "ego_graph": f"""{pairs}, u AS (SELECT DISTINCT a, b FROM e WHERE a <> b UNION SELECT DISTINCT b, a FROM e WHERE a <> b), r AS (SELECT DISTINCT group_id FROM ({_CONTIGS})),
          h AS (SELECT group_id AS root, group_id AS "at", 0 AS hops FROM r UNION ALL SELECT group_id, b, 1 FROM r JOIN u ON a = group_id UNION ALL SELECT group_id, y.b, 2 FROM r JOIN u x ON x.a = group_id JOIN u y ON y.a = x.b)
          SELECT root, "at", min(hops) AS hops FROM h GROUP BY 1, 2""",
        "report_changes": f"""WITH g AS ({_OBJECT}), m AS (SELECT group_id AS o, group_id % 1000 AS n, string_agg(gene_id::VARCHAR, ', ' ORDER BY gene_id) AS genes FROM g WHERE group_id <> group_id % 1000 GROUP BY 1, 2),
          a AS (SELECT count(*) AS k FROM (SELECT group_id % 1000 FROM g EXCEPT SELECT group_id FROM g)), b AS (SELECT count(*) AS k FROM (SELECT group_id FROM g EXCEPT SELECT group_id % 1000 FROM g))
          SELECT 'Gene ' || genes || ' moved from group ' || o || ' to ' || n AS line FROM m UNION ALL SELECT k || ' new groups added' FROM a WHERE k > 0 UNION ALL SELECT k || ' empty groups removed' FROM b WHERE k > 0""",
        "kmer_split": f"""WITH RECURSIVE g AS ({_SAID}), k AS ({_KMERS.format(key="gene_id, group_id, width", k=5)}),
          w AS (SELECT gene_id, group_id, width, kmer, n / sqrt(sum(n * n) OVER (PARTITION BY gene_id)::DOUBLE) AS w FROM k),
          e AS (SELECT a.gene_id AS i, b.gene_id AS j FROM w a JOIN w b ON a.kmer = b.kmer AND a.group_id = b.group_id AND a.gene_id < b.gene_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8 - 1e-12 AND abs(any_value(a.width) - any_value(b.width)) / greatest(any_value(a.width), any_value(b.width)) < 0.2),
          u AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
          r AS (SELECT gene_id, gene_id AS reach FROM g UNION SELECT r.gene_id, u.j FROM r JOIN u ON r.reach = u.i)
          SELECT gene_id, min(reach) AS first_gene FROM r GROUP BY 1""",
        "components": """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS u, -l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
          l AS (SELECT DISTINCT u AS node, u AS label, 0 AS step FROM b UNION ALL SELECT b.v, min(l.label), any_value(l.step) + 1 FROM l JOIN (SELECT u, v FROM b UNION SELECT u, u FROM b) b ON b.u = l.node WHERE l.step < 16 GROUP BY b.v)
          SELECT label AS component, count(*) AS n FROM (SELECT node, min(label) AS label FROM l GROUP BY 1) WHERE node >= 0 GROUP BY 1""",
        "evolution_bootstrap": f"""WITH g AS ({_PARTS}), x AS (SELECT n, rep, draw, (('0x' || substr(md5(n || ':' || rep || ':' || draw || ':1'), 1, 12))::BIGINT % 25) AS org_id FROM range(1, 26) a(n), range(1, 11) b(rep), range(1, 26) c(draw) WHERE draw <= n),
          d AS (SELECT DISTINCT org_id, group_id FROM g), s AS (SELECT n, rep, group_id, count(*) AS present FROM x JOIN d USING (org_id) GROUP BY ALL)
          SELECT n, rep, count(CASE WHEN present = 1 THEN 1 END) AS singleton, count(CASE WHEN present > 1 AND present / n::DOUBLE < 0.8 THEN 1 END) AS accessory, count(CASE WHEN present / n::DOUBLE >= 0.8 THEN 1 END) AS core, count(*) AS total FROM s GROUP BY ALL""",
        "group_changes": f"""WITH g AS ({_PARTS}), o AS (SELECT gene_id, group_id AS old_group FROM g WHERE org_id <> 3), n AS (SELECT gene_id, group_id % 500 AS new_group FROM g WHERE org_id <> 5)
          SELECT gene_id, old_group, new_group, CASE WHEN old_group IS NULL THEN 'added' WHEN new_group IS NULL THEN 'removed' ELSE 'moved' END AS change FROM o FULL JOIN n USING (gene_id) WHERE old_group IS DISTINCT FROM new_group""",
        "merge_pangenomes": f"""WITH g AS ({_PARTS}), t AS (SELECT (SELECT max(n_nationkey) FROM nation) AS o, max(gene_id) AS i, max(group_id) AS p FROM g),
          b AS (SELECT org_id, gene_id, group_id FROM g UNION ALL SELECT org_id + o, gene_id + i, group_id + p FROM g, t)
          SELECT org_id, count(*) AS n_genes, min(gene_id) AS first_gene, max(group_id) AS last_group FROM b GROUP BY 1""",
        "group_neighbors": f"WITH n AS (SELECT group_id, lag(group_id) OVER ({_WIN}) AS a, lead(group_id) OVER ({_WIN}) AS b FROM ({_CONTIGS})) SELECT group_id, a AS neighbor FROM n WHERE a IS NOT NULL UNION SELECT group_id, b FROM n WHERE b IS NOT NULL",
        "merge_info": "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS p_type, array_to_string(list_sort(list(DISTINCT p_size::VARCHAR)), ';') AS p_size FROM part GROUP BY 1",
        "largest_info": "SELECT p_brand, p_size, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1",
        "collapse_paralogues": f"WITH l AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) AS link FROM part), g AS (SELECT org_id, link AS group_id FROM ({_PARTS}) JOIN l ON group_id = p_partkey) {_INFO}",
        "read_annot": """WITH r AS (SELECT conv_id::VARCHAR AS name, CASE WHEN role = 'user' THEN 'GO:' ELSE 'EC:' END || turn AS annot, text, turn FROM conversations)
          SELECT name, min_by(text, turn) AS description, coalesce(array_to_string(list_sort(list(annot) FILTER (annot LIKE '%GO:%')), ';'), '') AS go, coalesce(array_to_string(list_sort(list(annot) FILTER (annot NOT LIKE '%GO:%')), ';'), '') AS ec FROM r GROUP BY 1""",
    }
