"""Small cases with known results."""

import random

import numpy as np
from pyspark.sql import functions as F

from syntenia.functions import kmers as K
from syntenia.operators import clustering as C
from syntenia.operators import graph as G
from syntenia.operators import matrix as M
from syntenia.operators import neighbors as N
from syntenia.operators import splitting as S
from syntenia.operators import tree as T
from syntenia.operators.components import components


def line(spark, groups, strand=1):
    rows = [(k, 1, "c", k, k, strand, g) for k, g in enumerate(groups, 1)]
    return spark.createDataFrame(rows, "gene_id long, org_id int, contig string, start int, end int, strand int, group_id long")


def test_neighbor_strings(spark):
    genes = line(spark, [1, 2, 3, 4, 5])
    rows = genes.select("gene_id", N.flank_string("group_id", 4).alias("f"), N.flank_string("group_id", 4, False).alias("b")).orderBy("gene_id").collect()
    assert [r["f"] for r in rows] == ["2;3;4;5", "3;4;5;NA", "4;5;NA;NA", "5;NA;NA;NA", "NA;NA;NA;NA"]
    assert [r["b"] for r in rows] == ["NA;NA;NA;NA", "1;NA;NA;NA", "2;1;NA;NA", "3;2;1;NA", "4;3;2;1"]
    assert [r["f"] for r in genes.select("gene_id", N.flank_string("group_id", 1).alias("f")).orderBy("gene_id").collect()] == ["2", "3", "4", "5", None]


def test_trail_edges(spark):
    trails = spark.createDataFrame([([1, 2, 3, 4, 5],), ([1, 2, 6, 4, 5],), ([1, 2, 3, 4, 7],), ([1, 2, 6, 4, 5],)], "trail array<long>")
    found = {(r["from"], r["to"]): r["n"] for r in N.trail_edges(trails).collect()}
    assert found == {(1, 2): 4, (2, 3): 2, (2, 6): 2, (3, 4): 2, (4, 5): 3, (4, 7): 1, (6, 4): 2}


def test_scaling(spark):
    one = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert {r["x"] for r in M.scale_range(one, "x", 1, 5).collect()} == {3.0}
    some = spark.createDataFrame([(float(k),) for k in range(1, 6)], "x double")
    assert sorted(r["x"] for r in M.scale_range(some, "x", 10, 50).collect()) == [10, 20, 30, 40, 50]


def test_route():
    fathers = dict(zip(range(1, 11), [2, 3, 4, 5, None, 5, 6, 7, 8, 1], strict=True))
    assert G.route(fathers, 1) == [5, 4, 3, 2, 1]
    assert G.route(fathers, 5) == [5]


def test_renumber(spark):
    df = spark.createDataFrame([(k, g) for k, g in enumerate([1, 1, 2, 5, 4, 5, 2])], "k int, group_id long")
    assert [r["group_id"] for r in M.renumber(df, "group_id").orderBy("k").collect()] == [1, 1, 2, 4, 3, 4, 2]


def test_kmers(spark):
    df = spark.createDataFrame([(1, "GATTCGATTAG"), (2, "GA"), (3, "GAT" * 400)], "gene_id long, sequence string")
    found = {(r["gene_id"], r["kmer"]): r["n"] for r in K.kmers(df, 3).collect()}
    assert {k: n for (g, k), n in found.items() if g == 1} == {"ATT": 2, "CGA": 1, "GAT": 2, "TAG": 1, "TCG": 1, "TTA": 1, "TTC": 1}
    assert {k: n for (g, k), n in found.items() if g == 3} == {"GAT": 400, "ATG": 399, "TGA": 399}
    assert not any(g == 2 for g, _ in found)


def test_prefix_filter_loses_nothing(spark):
    random.seed(3)
    rows = [(k, "".join(random.choice("ABC") for _ in range(random.randint(2, 30)))) for k in range(60)]
    spectrum = K.kmers(spark.createDataFrame(rows, "gene_id long, sequence string"), 3)
    for limit in (0.3, 0.7):
        every = {(r["i"], r["j"]) for r in K.cosine(spectrum, "gene_id").filter(F.col("sim") >= limit).collect()}
        assert {(r["i"], r["j"]) for r in K.cosine(spectrum, "gene_id", limit).collect()} == every


def test_cliques():
    # two triangles that share an edge's end, and a pair
    edges = [(1, 2, 5, 0.9, 0), (2, 3, 4, 0.9, 0), (1, 3, 4, 0.8, 0), (3, 4, 3, 0.9, 0), (4, 5, 6, 0.9, 0), (6, 7, 1, 0.5, 0)]
    assert sorted(map(tuple, S.extract_cliques(edges))) == [(1, 2, 3), (4, 5), (6, 7)]
    random.seed(1)
    for _ in range(50):
        e = [(i, j, random.randint(1, 5), random.random(), 0) for i in range(9) for j in range(i + 1, 9) if random.random() < 0.4]
        near = {frozenset(x[:2]) for x in e}
        found = S.extract_cliques(e)
        assert sorted(n for c in found for n in c) == sorted({n for x in e for n in x[:2]})
        assert all(frozenset((a, b)) in near for c in found for a in c for b in c if a < b)


def test_components_equal_union_find(spark):
    random.seed(2)
    edges = [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(n,) for n in up], "node long")
    found = components(nodes, spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == {n: top(n) for n in up}
    assert components(nodes, spark.createDataFrame([], "u long, v long")).count() == len(up)


def test_leader_clusters_equal_a_scan(spark):
    random.seed(4)
    rows = [(k, "".join(random.choice("AB") for _ in range(random.randint(3, 9)))) for k in range(40)]
    genes = spark.createDataFrame(rows, "gene_id long, sequence string")
    sims = {(r["i"], r["j"]) for r in K.cosine(K.kmers(genes, 2), "gene_id").filter("sim >= 0.8 - 1e-12").collect()}
    leaders, expect = [], {}
    for g, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = [x for x in reversed(leaders) if (min(x, g), max(x, g)) in sims]
        expect[g] = mine[0] if mine else g
        if not mine:
            leaders.append(g)
    found = {r["gene_id"]: r["leader"] for r in C.leader_clusters(genes, 2, 0.8).collect()}
    assert found == expect


def test_identity_clusters(spark):
    random.seed(5)
    base = ["".join(random.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)) for _ in range(4)]
    rows = []
    for f, s in enumerate(base):
        for c in range(5):
            t = list(s)
            for at in random.sample(range(60), c):
                t[at] = "A"
            rows.append((f * 10 + c, "".join(t) + ("*" if c == 2 else "")))
    genes = spark.createDataFrame(rows, "gene_id long, sequence string")
    found = {r["gene_id"]: r["leader"] for r in C.identity_clusters(genes, C.IdentityOptions(c=0.9)).collect()}
    assert len(found) == 20 and {g // 10 for g in found} == {v // 10 for v in found.values()} and all(g // 10 == v // 10 for g, v in found.items())
    assert C.identity("ACDEF", "ACDEF")[0] == 1 and C.identity("AAAA", "CCCC")[0] == 0
    assert abs(C.identity("ACDEFGHIKL", "ACDEYGHIKL")[0] - 0.9) < 1e-9
    grouped = C.identity_grouping(genes, lower=0.8).collect()
    assert len(grouped) == 20 and len({r["group_id"] for r in grouped}) == 4


def test_communities(spark):
    edges = [(i, j, 1.0) for c in (0, 10) for i in range(c, c + 4) for j in range(i + 1, c + 4)] + [(3, 10, 0.1)]
    df = spark.createDataFrame(edges, "i long, j long, sim double")
    genes = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 10, 11, 12, 13, 99)], "gene_id long")
    for name in ("label_prop", "cluster_louvain", "infomap"):
        group = {r["gene_id"]: r["group_id"] for r in C.graph_grouping(genes, df, name).collect()}
        assert len({group[k] for k in range(4)}) == 1 and len({group[k] for k in range(10, 14)}) == 1 and len(set(group.values())) == 3


def test_hclust():
    d = np.array([[0, 1, 4, 5], [1, 0, 4, 5], [4, 4, 0, 2], [5, 5, 2, 0]], float)
    for method, last in (("single", 4), ("complete", 5), ("average", 4.5)):
        merges = T.hclust(d, method)
        assert merges[0][:2] == (0, 1) and merges[1][:2] == (2, 3) and abs(merges[2][2] - last) < 1e-9
    assert T.cut_k(merges, 4, 2) == [1, 1, 2, 2] and T.leaf_order(merges, 4) == [0, 1, 2, 3]
    # Ward: two points at distance 2 merge at 2, then with a third at the centre's weighted distance
    assert abs(T.hclust(np.array([[0, 2, 9], [2, 0, 7], [9, 7, 0.0]]), "ward.D2")[0][2] - 2) < 1e-9


def test_variable_region(spark):
    # organism 1: 1-2-3-4-5-6, organism 2: 1-2-7-4-5-6 (3 or 7 between 2 and 4)
    rows = [(o * 10 + k, o, "c", k, k, 1, str(g)) for o, path in ((1, [1, 2, 3, 4, 5, 6]), (2, [1, 2, 7, 4, 5, 6])) for k, g in enumerate(path)]
    genes = spark.createDataFrame(rows, "gene_id long, org_id int, contig string, start int, end int, strand int, group_id string")
    (r,) = G.variable_regions(genes, 4).collect()
    assert r["members"] == ["2", "3", "4", "7"] and r["flank"] == ["2", "4"] and r["type"] == "frameshift" and r["connects_to"] == ["1", "5"]
