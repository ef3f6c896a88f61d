"""Operators whose work must not grow with pairs or samples of all rows, and their results against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from syntenia import queries as Q
from syntenia.functions import pairs as P
from syntenia.operators import clustering as C
from syntenia.operators import matrix as M
from syntenia.operators import splitting as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bootstrap_of_many_organisms(spark):
    genes = [(g, g * 7 % 70 if g % 3 else g * g % 70, (g * 13 + k) % 90) for g in range(200) for k in range(3)] + [(9999, 99, 1)]
    df = spark.createDataFrame(genes, "gene_id long, org_id long, group_id long")
    orgs = spark.createDataFrame([(o,) for o in range(70)], "org_id long")
    found = M.evolution_bootstrap(df, 70, orgs, 0.1, 2)
    of = {}
    for _, o, g in genes:
        of.setdefault(g, set()).add(o)
    want = {}
    for n in range(1, 71):
        for rep in (1, 2):
            drawn = Counter(int(hashlib.md5(f"{n}:{rep}:{d}:1".encode()).hexdigest()[:12], 16) % 70 for d in range(1, n + 1))
            present = [p for p in (sum(drawn[o] for o in own) for own in of.values()) if p]
            if present:
                want[n, rep] = (present.count(1), sum(p > 1 and p / n < 0.1 for p in present), sum(p / n >= 0.1 for p in present), len(present))
    assert {(r.n, r.rep): tuple(r)[2:] for r in found.collect()} == want
    # samples meet groups' masks, never the groups themselves
    assert not re.search(r"Aggregate \[n#\d+L?, rep#\d+L?, group_id#", plan_of(found))


def test_band_pairs_at_the_limit(spark, tmp_path):
    widths = [float(f"{w:.3f}") for k in range(200) for w in (1000 * 1.001**k, 900 + k * 0.9, 1000.0)]
    rows = [(k, f"b{k % 2}", w) for k, w in enumerate(widths)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    want = {(a, i, j) for i, a, x in rows for j, b, y in rows if i < j and a == b and abs(x - y) / min(x, y) <= 0.001}
    found = Q.queries()["length_band_pairs"](spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    # only genes of one band or the next meet
    assert re.search(r"Join Inner, .*_band#", plan_of(found))


def test_similar_pairs_by_blocks(spark, monkeypatch):
    draw = random.Random(3)
    base = ["".join(draw.choice(letters) for _ in range(400)) for letters in ("abcdef", "abcdef", "äöü中文\U0001f600z", "ab")]
    texts = [(k, k % 3 if k % 5 else None, "".join(c if draw.random() > rate else "x" for c in base[k % 4])) for k, rate in enumerate([0.0, 0.005, 0.02, 0.1] * 30)] + [(500, 1, "abc"), (501, 1, None), (502, 1, "abcde"), (503, 1, "abcde")]
    genes = spark.createDataFrame(texts, "gene_id long, role long, sequence string")
    spectra = {g: (r, Counter(s[i : i + 5] for i in range(len(s) - 4))) for g, r, s in texts if s and len(s) >= 5}
    norm = {g: math.sqrt(sum(n * n for n in c.values())) for g, (_, c) in spectra.items()}
    sims = {(i, j): sum(n * spectra[j][1][w] for w, n in spectra[i][1].items()) / norm[i] / norm[j] for i in spectra for j in spectra if i < j}
    monkeypatch.setattr(P, "ROWS", 40)
    for limit in (0.9, 0.3):
        for block in (None, "role"):
            want = {p: s for p, s in sims.items() if s >= limit - 1e-12 and (block is None or spectra[p[0]][0] == spectra[p[1]][0] is not None)}
            rows = P.similar_pairs(genes, 5, limit, block).collect()
            assert len(rows) == len(want) and all(abs(want[r.i, r.j] - r.sim) < 1e-12 for r in rows)
    assert P.similar_pairs(genes.limit(0), 5, 0.9).collect() == []


def test_rescaled_pairs_are_not_joined_by_kmer(spark):
    assert "kmer#" not in plan_of(Q.queries()["rescaled_sim"](spark, "/root/testdata/sf0.001"))


def test_all_pairs_cut_each_sequence_once(spark, monkeypatch):
    draw = random.Random(7)
    base = ["".join(draw.choice(letters) for _ in range(300)) for letters in ("abcdef", "äöü中文\U0001f600z")]
    own = [(f"g{k}", "".join(c if draw.random() > rate else "x" for c in base[k % 2])) for k, rate in enumerate([0.0, 0.01, 0.03, 0.2] * 25)] + [("ä", "a" * 70000), ("ö", "a" * 50000), ("short", "abc"), (None, "abcde"), ("none", None)]
    genes = spark.createDataFrame(own, "gene_id string, sequence string")
    spectra = {g: Counter(s[i : i + 5] for i in range(len(s) - 4)) for g, s in own if g and s and len(s) >= 5}
    norm = {g: math.sqrt(sum(n * n for n in c.values())) for g, c in spectra.items()}
    want = {(i, j): sum(n * spectra[j][w] for w, n in spectra[i].items()) / norm[i] / norm[j] for i in spectra for j in spectra if i < j}
    want = {p: s for p, s in want.items() if s >= 0.8 - 1e-12}
    for rows in (4096, 30, 20):  # one block, an even and an odd number of them
        monkeypatch.setattr(P, "ROWS", rows)
        found = P.similar_pairs(genes, 5, 0.8).collect()
        assert len(found) == len(want) and all(abs(want[r.i, r.j] - r.sim) < 1e-12 for r in found)
    # what is written of two blocks is enough for them to meet, without their texts
    kept = [(g, s) for g, s in own if g in spectra]
    one, two = (P._counted(5)(pa.table({"id": [g for g, _ in part], "text": [s for _, s in part], "part": pa.array([n] * len(part), pa.int32())})) for n, part in enumerate((kept[::2], kept[1::2])))
    monkeypatch.setattr(P, "words", None)
    met = [p for table in (one, two) for batch in P._alike(SimpleNamespace(value=one.to_pylist()[0]), 0, P.Cosine(0.8), ["i", "j", "sim"])(iter(table.to_batches())) for p in batch.to_pylist()]
    first = {g for g, _ in kept[::2]}
    assert {(min(p["i"], p["j"]), max(p["i"], p["j"])) for p in met} == {p for p in want if set(p) & first} and len(met) == sum(bool(set(p) & first) for p in want)


def _cliques_by_scans(edges):
    """The best edge, then again and again the best edge to a common neighbor, by a scan of all edges."""
    ranked = sorted(edges, key=lambda e: (-e[2], -e[3], -e[4], e[0], e[1]))
    near, out = {}, []
    for i, j, *_ in ranked:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    left = set(near)
    for i, j, *_ in ranked:
        if i in left and j in left:
            own, common = {i, j}, near[i] & near[j] & left
            while common:
                add = next(b if a in own else a for a, b, *_ in ranked if (a in own and b in common) or (b in own and a in common))
                own.add(add)
                common &= near[add]
            out.append(sorted(own))
            left -= own
    return sorted(out + [[n] for n in left])


def test_cliques_of_a_large_component(spark):
    draw = random.Random(5)
    for share in (0.2, 0.5, 0.9, 1.0):
        edges = [(3 * i, 3 * j, draw.randint(0, 3), draw.randint(0, 2) / 2, draw.randint(0, 1)) for i in range(40) for j in range(i + 1, 40) if draw.random() < share]
        assert sorted(S.extract_cliques(edges)) == _cliques_by_scans(edges)
    parts = edges + [(1000 + i, 1000 + j, draw.randint(0, 3), 0.5, 0) for i in range(30) for j in range(i + 1, 30) if draw.random() < 0.4] + [(5000, 5001, 1, 0.5, 0)]
    genes = spark.createDataFrame([(g,) for g in range(6000)], "gene_id long")
    found = {}
    for r in S.cliques(genes, spark.createDataFrame(parts, "i long, j long, n_sim long, s_sim double, g_sim long")).collect():
        found.setdefault(r.root, []).append(r.gene_id)
    assert all(root == min(own) for root, own in found.items()) and sorted(g for own in found.values() for g in own) == list(range(6000))
    tied = {g for e in parts for g in e[:2]}
    assert sorted(sorted(own) for own in found.values() if own[0] in tied) == _cliques_by_scans(parts)
    # 1,200 nodes, all tied: some 720,000 edges; a scan of them for each new member of a clique took minutes
    i, j = np.triu_indices(1200, 1)
    at = np.random.default_rng(1).permutation(len(i))
    nodes, root = S._grown(i[at][: len(i) // 2], j[at][: len(i) // 2])
    assert len(nodes) == 1200 and len(np.unique(root)) < 300


def test_identity_candidates_by_blocks(spark, monkeypatch):
    draw = random.Random(7)
    base = ["".join(draw.choice(letters) for _ in range(n)) for letters, n in (("abcdef", 60), ("abcdef", 66), ("äÖ中\U0001f600*", 80), ("ab", 120))]
    texts = [(k, "".join(c if draw.random() > rate else "x" for c in base[k % 4])[: draw.randint(4, 120)] + "*" * (k % 2)) for k, rate in enumerate([0.0, 0.02, 0.05, 0.1, 0.3] * 24)] + [(k, base[0][:50] + "q" * (k % 3)) for k in range(500, 520)] + [(900, None), (901, "abcd*"), (902, "")]
    genes = spark.createDataFrame(texts, "gene_id long, sequence string")
    monkeypatch.setattr(P, "ROWS", 16)
    for o in (C.IdentityOptions(s=0.8), C.IdentityOptions(c=0.7, S=5), C.IdentityOptions(c=0.5, k=3)):
        clean = {g: re.sub(r"\*+$", "", t.upper()) for g, t in texts if t}
        words = {g: Counter(t[i : i + o.k] for i in range(len(t) - o.k + 1)) for g, t in clean.items() if len(t) >= o.k}
        want = set()
        for i in words:
            for j in words:
                short, long = sorted((len(clean[i]), len(clean[j])))
                if i < j and long <= (min(short / o.s, short + o.S) if o.s else short + o.S) and sum((words[i] & words[j]).values()) >= max(1, short - (o.k - 1) - (1 - o.c) * short * o.k) - 1e-9:
                    want.add((i, j))
        found = C.identity_candidates(genes, o)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert "kmer#" not in plan_of(found)  # not joined by word
    assert C.identity_candidates(genes.limit(0), C.IdentityOptions()).collect() == []


def test_neighborhood_pairs_by_parts(spark, monkeypatch):
    draw = random.Random(11)
    rows = []
    for g in range(160):
        flank = None if g % 40 == 7 else [draw.choice(["a", "b", "c", "d", None][: 4 + g % 2]) for _ in range(draw.randint(0, 5))]
        rows.append((g * 7 % 160, draw.choice(["x", "x", "y", None]), draw.choice([1, 1, 2, 3, None]), draw.choice([90, 99, 100, 101, 109, 110, 120, 150, 1, None]), flank))
    genes = spark.createDataFrame(rows, "gene_id long, group_id string, org_id long, width long, flank array<string>")

    def want(apart, limit):
        out = set()
        for i, g, o, w, a in rows:
            for j, h, p, x, b in rows:
                if i < j and g == h is not None and None not in (w, x) and a and b and (not apart or (None not in (o, p) and o != p)) and abs(w - x) / (1 if limit >= 1 else min(w, x)) <= limit:
                    n = sum(s == t for s, t in zip([s for s in a if s is not None and s in b], [t for t in b if t is not None and t in a], strict=False))
                    if n:
                        out.add((g, i, j, n))
        return out

    for part, tile in ((4096, 1 << 16), (7, 40)):
        monkeypatch.setattr(S, "PART", part)
        monkeypatch.setattr(S, "TILE", tile)
        monkeypatch.setattr(S, "BATCH", tile)
        for apart, limit in ((True, 0.1), (False, 0.1), (True, 0.0), (False, 9.0)):
            found = S.neighborhood_similarity_of(genes, apart, limit)
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == want(apart, limit)
    # pairs are not made by a join and looked at one by one
    assert "arrays" not in plan_of(found) and "zip_with" not in plan_of(found) and "flank_j" not in plan_of(found)
    assert S.neighborhood_similarity_of(genes.limit(0), True, 0.1).collect() == []


def test_levels_rule_out_most_pairs(spark):
    draw = random.Random(13)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9))) for _ in range(400)]
    prose = [" ".join(draw.choice(words) for _ in range(draw.choice((20, 100, 500)))) for _ in range(120)]
    texts = [t if n % 4 else prose[0] + t[:60] for n, t in enumerate(prose)] + ["ab" * 300, "ab" * 5]
    one = P._counted(5, 0.9)(pa.table({"id": list(range(len(texts))), "text": texts, "part": pa.array([0] * len(texts), pa.int32())})).to_pylist()[0]
    block = P._Counted(one, np.empty(0, np.uint64))
    left = {(x, y) for a in block.chunks() for b in block.chunks() for x, y in zip(*P._open(block, a, block, b, P.Cosine(0.9), (-1, 0)), strict=True)}
    spectra = [Counter(texts[n][i : i + 5] for i in range(len(texts[n]) - 4)) for n in block.ids.to_pylist()]
    norm = [math.sqrt(sum(n * n for n in c.values())) for c in spectra]
    want = {(x, y) for x, a in enumerate(spectra) for y, b in enumerate(spectra) if sum(n * b[w] for w, n in a.items()) >= 0.9 * norm[x] * norm[y]}
    assert want <= left and len(left) < 0.6 * len(texts) ** 2
    # blocks of unlike sequences never meet
    far = P._Coarse(P._counted(5, 0.9)(pa.table({"id": [0], "text": ["äöü中文ß" * 40 + "xyz"], "part": pa.array([1], pa.int32())})).to_pylist()[0])
    assert not any(len(P._open(far, (0, 1), block, y, P.Cosine(0.9), (-1, 0))[0]) for y in block.chunks())


def test_neighborhood_parts_are_sent_few_times(spark):
    genes = spark.range(40_000).selectExpr("id AS gene_id", "'x' AS group_id", "id % 7 AS org_id", "1 AS width", "array('a', 'b') AS flank")
    rows, key = S._meetings(genes, True, 0.1)
    # a group of 40,000 has two parts, each of which meets itself and the other
    assert rows.count() <= 3 * 40_000 and rows.select(*key).distinct().count() == 3


def test_leaders_without_a_task_for_a_component(spark, monkeypatch):
    draw = random.Random(17)
    ids = draw.sample(range(1000), 60)
    texts = {g: f"{draw.choice('abäz中')}{draw.randint(0, 20)}" for g in ids}
    edges = [(i, j) for i in ids for j in ids if i < j and draw.random() < 0.15]
    near, leader, when = {g: {x for e in edges if g in e for x in e if x != g} for g in ids}, {}, []
    for g in sorted(ids, key=lambda g: (texts[g].encode(), g)):
        mine = [x for x in when if x in near[g]]
        leader[g] = mine[-1] if mine else g
        when += [g] if not mine else []
    one = spark.createDataFrame([(g, t) for g, t in texts.items()] + [(5000, "b"), (5001, None)], "gene_id long, sequence string")
    links = spark.createDataFrame(edges, "i long, j long")
    for scanned, rounds in ((0, 25), (0, 1), (10**6, 25)):  # all by rounds; one round and a scan; a scan
        monkeypatch.setattr(C, "SCANNED", scanned)
        monkeypatch.setattr(C, "ROUNDS", rounds)
        assert {r.gene_id: r.leader for r in C._led(one, links).collect()} == leader | {5000: 5000, 5001: 5001}


def test_rescaled_pairs_come_by_languages(spark, monkeypatch):
    dealt, real = [], P._dealt

    def seen(own):
        dealt.append({r.kind for r in own.select("kind").distinct().collect()})
        return real(own)

    monkeypatch.setattr(P, "_dealt", seen)
    Q.queries()["rescaled_sim"](spark, "/root/testdata/sf0.001")
    assert dealt and {"en", "de", "fr", "es"} <= dealt[0]
