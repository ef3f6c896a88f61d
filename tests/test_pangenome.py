"""FASTA to pangenome and back, on files made here."""

import random

import pytest
from pyspark.sql import functions as F

from syntenia.pangenome import Pangenome, group_changes, match_groups
from syntenia.sources.annotation import read_annotation
from syntenia.sources.fasta import add_location, count_records, normalize_sequences, read_fasta

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def family(seed, n=50):
    r = random.Random(seed)
    return "".join(r.choice(LETTERS) for _ in range(n))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Three organisms on one contig: families 0..5; the second lacks 3, the third has 9 for 4."""
    d = tmp_path_factory.mktemp("fasta")
    out = []
    for o, fams in enumerate(([0, 1, 2, 3, 4, 5], [0, 1, 2, 4, 5], [0, 1, 2, 3, 9, 5])):
        text = ""
        for k, f in enumerate(fams, 1):
            s = list(family(f))
            s[o] = "A"
            text += f">ctg{o}_{k} # {k * 100} # {k * 100 + 50} # {-1 if k == 2 else 1} # ID={k}\n{''.join(s[:30])}\n{''.join(s[30:])}\n"
        p = d / f"org{o}.fasta"
        p.write_text(text)
        out.append(str(p))
    return out


@pytest.fixture(scope="module")
def pg(spark, files):
    return Pangenome.load(spark, files, True, "prodigal")


@pytest.fixture(scope="module")
def grouped(pg):
    return pg.identity_grouping(lower=0.8)


def test_fasta(spark, files, tmp_path):
    genes, organisms = read_fasta(spark, files)
    assert [r["n_genes"] for r in organisms.orderBy("org_id").collect()] == [6, 5, 6]
    rows = genes.orderBy("gene_id").collect()
    assert [r["gene_id"] for r in rows] == list(range(1, 18)) and all(r["width"] == 50 for r in rows) and rows[6]["desc"].startswith("ctg1_1 # 100")
    assert {r["n"] for r in count_records(spark, files).collect()} == {5, 6}
    odd = tmp_path / "odd.fa"
    odd.write_text(">a\nACD*\n>b\n\n>c\nAC1\n")
    empty = tmp_path / "none.fa"
    empty.write_text("")
    with pytest.warns(UserWarning):
        g, o = read_fasta(spark, [str(odd), str(empty)])
        assert [(r["gene_id"], r["desc"]) for r in g.orderBy("gene_id").collect()] == [(1, "a"), (2, "c")]
    assert [r["sequence"] for r in normalize_sequences(g).collect()] == ["ACD"]


def test_location(spark, pg):
    loc = pg.location().orderBy("gene_id").collect()
    assert (loc[1]["contig"], loc[1]["start"], loc[1]["end"], loc[1]["strand"]) == ("ctg0", 200, 250, -1)
    plain = pg.genes_.drop("contig", "start", "end", "strand")
    same = [add_location(plain, pg.location()), add_location(plain, [tuple(r)[1:] for r in loc]), add_location(plain, lambda g: pg.location())]
    assert all(x.select("gene_id", "contig", "strand").orderBy("gene_id").collect() == pg.location().select("gene_id", "contig", "strand").orderBy("gene_id").collect() for x in same)
    with pytest.raises(ValueError):
        add_location(plain, pg.location().withColumn("strand", F.lit(0)))
    with pytest.raises(ValueError):
        add_location(plain, "nothing")


def test_grouping_and_info(grouped):
    info = {r["group_id"]: (r["n_org"], r["n_genes"], r["class"]) for r in grouped.group_info().collect()}
    assert sorted(info.values()) == sorted([(3, 3, "Core")] * 4 + [(2, 2, "Accessory")] * 2 + [(1, 1, "Singleton")])
    assert grouped.summary()["groups"] == 7 and [r["n_genes"] for r in grouped.org_stat().orderBy("org_id").collect()] == [6, 5, 6]
    loose = grouped.set_defaults(core_threshold=0.6)
    assert sum(r["class"] == "Core" for r in loose.group_info().collect()) == 6
    with pytest.raises(ValueError):
        grouped.set_defaults(translated=False)
    assert grouped.group_stat().count() == 7 and grouped.plot_stat().count() == 2 + 2 + 3
    assert grouped.tree().count() == 2 and grouped.tree("kmer").count() == 2


def test_other_groupings_agree(pg, grouped):
    want = {frozenset(r["g"]) for r in grouped.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()}
    for other in (pg.graph_grouping(), pg.tree_grouping(), pg.manual_grouping([sorted(x) for x in want]), pg.identity_grouping(iterate=False)):
        assert {frozenset(r["g"]) for r in other.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()} == want


def test_splits_refine(grouped):
    one = grouped.manual_grouping([1] * 17)
    want = {frozenset(r["g"]) for r in grouped.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()}
    for split in (one.kmer_split(), grouped.kmer_split()):
        assert {frozenset(r["g"]) for r in split.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()} == want
    refined = grouped.neighborhood_split(flank_size=2)
    groups = {frozenset(r["g"]) for r in refined.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()}
    assert sum(map(len, groups)) == 17 and all(any(g <= w for w in want) for g in groups)


def test_merge_leaves_no_like_group(spark):
    """More than fifty groups beside one knot, all alike, merge until the knot has two neighbors and is none."""
    from syntenia.operators.splitting import neighborhood_merge

    r = random.Random(3)
    one = "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(40))
    rows = [(c * 2 + k, c, "c", k * 100, k * 100 + 40, 1, 0 if k == 0 else c + 1, one if k else one[::-1], 40) for c in range(60) for k in (0, 1)]
    genes = spark.createDataFrame(rows, "gene_id long, org_id int, contig string, start int, end int, strand int, group_id long, sequence string, width int")
    merged = neighborhood_merge(genes).select("gene_id", "group_id").collect()
    assert len(merged) == 120 and {x.group_id for x in merged if x.gene_id % 2 == 0} == {0} and len({x.group_id for x in merged if x.gene_id % 2}) == 2


def test_subset_and_removal(grouped):
    two = grouped.subset([3, 1])
    assert two.n_genes() == 12 and sorted(r["org_name"] for r in two.organisms.collect()) == ["org0", "org2"]
    assert grouped.subset(["org1"]).n_genes() == 5 and grouped.subset([True, False]).n_organisms() == 2
    with pytest.raises(KeyError):
        grouped.subset(["nobody"])
    less = grouped.remove_genes(ids=[1, 2])
    assert less.n_genes() == 15 and sorted(r["gene_id"] for r in less.genes_.collect()) == list(range(1, 16))
    assert grouped.remove_genes(organisms=[1], ind=[1]).n_genes() == 16 and grouped.remove_genes(groups=["OG1"]).n_groups() == 6
    with pytest.warns(UserWarning):
        assert grouped.remove_genes(names=["nothing"]) is grouped


def test_metadata_links_and_collapse(spark, grouped):
    info = spark.createDataFrame([(1, "x"), (2, "y")], "group_id long, note string")
    noted = grouped.add_group_info(info)
    assert {r["group_id"]: r["note"] for r in noted.group_info().collect()}[2] == "y"
    with pytest.raises(ValueError):
        grouped.add_group_info(info.withColumn("n_genes", F.lit(1)))
    linked = noted.link()
    assert linked.has_paralogue_links and linked.genes("paralogue").count() == 7
    assert linked.collapse().n_groups() == 7 and linked.collapse("largest").group_meta.count() == 7


def test_growth(spark, files, grouped):
    old = Pangenome.load(spark, files[:2], True, "prodigal").identity_grouping(lower=0.8)
    grown = old.add_genomes(Pangenome.load(spark, files[2:], True, "prodigal"))
    want = {frozenset(r["g"]) for r in grouped.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()}
    assert {frozenset(r["g"]) for r in grown.genes_.groupBy("group_id").agg(F.collect_list("gene_id").alias("g")).collect()} == want
    kept = grown.genes_.select("gene_id", F.col("group_id").alias("n")).join(old.genes_.select("gene_id", "group_id"), "gene_id")
    assert kept.filter("n <> group_id").isEmpty()
    assert {r["change"] for r in group_changes(grown.genes_, old.genes_).collect()} == {"added"}


def test_match_groups_is_greedy(spark):
    r = random.Random(6)
    rows = [(k, r.randint(1, 6), r.randint(1, 6)) for k in range(80)]
    left = sorted(((sum(x[1] == a and x[2] == b for x in rows), a, b) for a in range(1, 7) for b in range(1, 7)), key=lambda x: (-x[0], x[1], x[2]))
    want = {}
    for n, a, b in left:
        if n and a not in want and b not in want.values():
            want[a] = b
    new, old = (spark.createDataFrame([(x[0], x[c]) for x in rows], "gene_id long, group_id long") for c in (1, 2))
    found = {x["new_id"]: x["group_id"] for x in match_groups(new, old).collect()}
    assert {a: b for a, b in found.items() if b <= 6} == want


def test_annotation(spark, tmp_path):
    p = tmp_path / "a.annot"
    p.write_text("g1\tGO:1\tfirst\ng1\tEC:2\ng2\tGO:3\tother\ng1\tGO:4\tsecond\n")
    found = {r["name"]: (r["description"], r["GO"], r["EC"]) for r in read_annotation(spark, str(p)).collect()}
    assert found == {"g1": ("first", ["GO:1", "GO:4"], ["EC:2"]), "g2": ("other", ["GO:3"], [])}


def test_streaming_growth(spark, files, tmp_path):
    import shutil

    from syntenia.streaming.growth import grow_on_arrival

    watched = tmp_path / "in"
    watched.mkdir()
    shutil.copy(files[2], watched / "org2.fasta")
    held = [Pangenome.load(spark, files[:2], True, "prodigal").identity_grouping(lower=0.8)]
    grow_on_arrival(spark, str(watched), lambda: held[-1], held.append, str(tmp_path / "state")).awaitTermination()
    assert len(held) == 2 and held[-1].n_organisms() == 3 and held[-1].n_groups() == 7
