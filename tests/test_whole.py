"""Queries without SQL, against brute force over all rows."""

import math
from collections import Counter

from syntenia import queries as Q

DATA = "/root/testdata/sf0.001"


def all_cosines(spark, k=5):
    rows = Q.texts(spark, DATA).select("gene_id", "block", "sequence").collect()
    spectra = {r.gene_id: Counter(r.sequence[i : i + k] for i in range(len(r.sequence) - k + 1)) for r in rows if len(r.sequence or "") >= k}
    norm = {g: math.sqrt(sum(n * n for n in c.values())) for g, c in spectra.items()}
    sims = {(i, j): sum(n * spectra[j][w] for w, n in spectra[i].items()) / norm[i] / norm[j] for i in spectra for j in spectra if i < j}
    return {r.gene_id: r.block for r in rows}, sims


def test_cosine_pairs_of_all_blocks(spark):
    block, sims = all_cosines(spark)
    want = {p: s for p, s in sims.items() if s >= 0.9}
    assert any(block[i] != block[j] for i, j in want)
    found = {(r.i, r.j): r.sim for r in Q.queries()["kmer_cosine_pairs"](spark, DATA).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - s) < 1e-8 for p, s in want.items())
    scaled = {(r.i, r.j): r.sim for r in Q.queries()["rescaled_sim"](spark, DATA).collect()}
    assert scaled.keys() == want.keys() and all(abs(scaled[p] - math.sqrt(max((s - 0.9) / 0.1, 0))) < 1e-5 for p, s in want.items())
    leader = {r.gene_id: r.leader for r in Q.queries()["leader_clusters"](spark, DATA).collect()}
    assert any(block[g] != block[x] for g, x in leader.items()) and all(g == x or sims[min(g, x), max(g, x)] >= 0.9 for g, x in leader.items())


def test_components_of_all_orders(spark, tmp_path):
    orders = [(k, k % 7 + 100 * (k % 3), float(k * 1000)) for k in range(1, 40)]
    lines = [(k, (k % 3) * 50 + j * (k % 7)) for k, _, _ in orders for j in (0, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    customer = {k: c for k, c, _ in orders}
    for k, part in lines:
        up[top(("c", customer[k]))] = top(("p", part))
    sizes = Counter(top(("c", c)) for c in set(customer.values()))
    assert len(sizes) > 1
    assert sorted(r.n for r in Q.queries()["components"](spark, str(tmp_path)).collect()) == sorted(sizes.values())


def test_neighborhood_similarity_of_all_pairs(spark):
    contigs, genes = {}, {r.gene_id: r for r in Q.contigs(spark, DATA).collect()}
    for r in sorted(genes.values(), key=lambda r: (r.start, r.gene_id)):
        contigs.setdefault((r.org_id, r.contig), []).append(r.gene_id)
    flank = {}
    for own in contigs.values():
        for at, g in enumerate(own):
            before, after = own[max(0, at - 2) : at][::-1], own[at + 1 : at + 3]
            flank[g] = [genes[x].group_id for x in (before + after if genes[g].strand == 1 else after + before)]
    want, members = {}, {}
    for g, r in sorted(genes.items()):
        members.setdefault(r.group_id, []).append(g)
    for own in members.values():
        for i in own:
            for j in own:
                if i < j and genes[i].org_id != genes[j].org_id:
                    a, b = set(flank[i]), set(flank[j])
                    n = sum(x == y for x, y in zip([x for x in flank[i] if x in b], [y for y in flank[j] if y in a], strict=False))
                    if n:
                        want[i, j] = n
    found = {(r.i, r.j): r.n_sim for r in Q.queries()["neighborhood_similarity"](spark, DATA).collect()}
    assert any(i % 20 != j % 20 for i, j in want) and found == want


def test_renumber_all_orders(spark):
    own = {r.gene_id: r.group_id for r in Q.parts(spark, DATA, "l_orderkey").collect()}
    rank = {g: k for k, g in enumerate(sorted(set(own.values())), 1)}
    assert {r.gene_id: r.group_id for r in Q.queries()["renumber"](spark, DATA).collect()} == {g: rank[x] for g, x in own.items()}


def test_cliques_of_turns(spark):
    rows = {r.gene_id: r for r in Q.said(spark, DATA).collect()}
    spectra = {g: Counter(r.sequence[i : i + 5] for i in range(len(r.sequence) - 4)) for g, r in rows.items()}
    norm = {g: math.sqrt(sum(n * n for n in c.values())) for g, c in spectra.items()}
    members = {}
    for r in Q.queries()["cliques"](spark, DATA).collect():
        members.setdefault(r.root, []).append(r.gene_id)
    assert sorted(g for own in members.values() for g in own) == sorted(rows) and max(map(len, members.values())) > 1
    for own in members.values():
        for i in own:
            for j in own:
                if i < j:
                    assert rows[i].group_id == rows[j].group_id
                    assert sum(n * spectra[j][w] for w, n in spectra[i].items()) / norm[i] / norm[j] >= 0.3 - 1e-9
