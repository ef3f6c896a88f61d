"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syntenia.plans import tables
from syntenia.llm import bloom_lm, decontaminate, exact_dedup, language_id, mixing, queries, simhash, token_counts, toxicity, url_filter, wavelet

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 40_000
ROWS = [(1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, "der schnelle braune Fuchs springt über den Hund", "de", None), (2, "another text with the same id", "en", "b"), (None, "a row without an id", "en", "b"), (None, "a row without an id", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n", None, "a"), (6, "123 !?", "en", "b"), (7, LONG, "en", "c")]
CLASHES = ["id", "key", "_lost", "_m", "_copies", "_copy", "row", "norm", "h", "fp", "own", "root", "doc", "copies", "size", "u", "boost", "item_id", "weight", "rank", "place", "s", "c"]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 0) for r in rows], DOC)


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "schnelle braune Fuchs springt über den"), (2, None), (3, ""), (1, "schnelle braune Fuchs springt über den")], "item_id long, text string")


FOX, SAME = (1, ROWS[0][1]), (2, ROWS[3][1])
STAGES = {
    # of equal rows one stays; of one id with two texts both
    "drop_exact": (lambda d, b: exact_dedup.drop_exact(d), [FOX, (2, ROWS[2][1]), SAME, (None, ROWS[4][1]), (3, None), (5, " \t\n"), (6, "123 !?"), (7, LONG)]),
    "drop_near": (lambda d, b: simhash.drop_near(d), [FOX, (2, ROWS[2][1]), SAME, (None, ROWS[4][1]), (3, None), (6, "123 !?"), (7, LONG)]),
    "drop_similar": (lambda d, b: simhash.drop_similar(d), [FOX, (2, ROWS[2][1]), SAME, (None, ROWS[4][1]), (3, None), (6, "123 !?"), (7, LONG)]),
    "drop_contaminated": (lambda d, b: decontaminate.drop_contaminated(d, b), [(r[0], r[1]) for r in ROWS if "Fuchs" not in (r[1] or "")]),
    "keep_identified": (lambda d, b: language_id.keep_identified(d), [(r[0], r[1]) for r in ROWS if r[1] and any(c.isalpha() for c in r[1])]),
}


@pytest.mark.parametrize("name", STAGES)
def test_filters(spark, bench, name):
    f, want = STAGES[name]
    for df in (table(spark), clashing(table(spark))):
        got = f(df.repartition(3), bench)
        assert got.columns == df.columns and texts(got) == sorted(want, key=str)
    assert f(table(spark, []), bench).count() == 0


def test_ids_of_any_type(spark, bench):
    df = table(spark).withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    assert exact_dedup.drop_exact(df).count() == simhash.drop_near(df).count() + 1 == 8
    assert simhash.drop_similar(df).count() == 7
    assert {r["doc_id"] for r in decontaminate.contaminated(df, bench).collect()} == {"x2"}
    assert mixing.mixture(df).count() == len(ROWS) and mixing.mix(df).columns == df.columns
    assert bloom_lm.score(df).count() == len(ROWS)


def test_mix_takes_rows(spark):
    for df in (table(spark), clashing(table(spark))):
        plan = mixing.mixture(df).collect()
        mixed = mixing.mix(df)
        assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in plan if r["size"])
        assert not any(r["taken"] for r in plan if not r["size"])
        assert all(t and t.strip() for _, t in texts(mixed))
    assert mixing.mix(table(spark, [])).count() == 0


def test_tables_go(spark, monkeypatch, tmp_path):
    """Only what a result reads is left while it lasts, and nothing after the scope."""
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    left = lambda: sorted({p.parent.name.split("-")[0] for p in tmp_path.rglob("*.parquet")})
    with tables.scope():
        assert simhash.drop_similar(table(spark)).count() == 7 and left() == ["lost", "repeated"]
    assert left() == []
    with tables.scope():
        assert bloom_lm.score(table(spark)).count() == len(ROWS) and left() == ["answers", "blocks"]
    assert left() == []


def test_equal_ids_enter_together(spark):
    df = table(spark, [(None, "a b", "en", f"s{k % 2}") for k in range(400)])
    rows = mixing.mixture(df).collect()
    assert all(len({r["copies"] for r in rows if r["source"] == s}) == 1 for s in ("s0", "s1"))


def vocabulary(name):
    return queries.vocabulary(name)


OPERATORS = {
    "bloom_lm": lambda d: bloom_lm.score(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "similar": lambda d: simhash.similar_duplicates(d),
    "token_counts": lambda d: token_counts.count_tokens(d, vocabulary("piece_bpe_32k.model")),
    "wavelet": lambda d: wavelet.token_output(d, vocabulary("word_bpe_49k.json")),
    "mixing": lambda d: mixing.mixture(d),
    "language_id": lambda d: language_id.identify(d),
    "exact_dedup": lambda d: exact_dedup.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(spark, name):
    f = OPERATORS[name]
    plain, clash = f(table(spark)).collect(), f(clashing(table(spark))).collect()
    assert len(plain) == len(ROWS) and sorted(map(str, plain)) == sorted(map(str, clash))
    assert f(table(spark, [])).count() == 0


def test_toxicity_goes_on_after_a_long_text(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*(r.choice(words) for _ in range(20)), "vilest" if k % 3 == 0 else "fine"]), None, None) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(500, 1), (501, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    long = [(500, LONG, None, None), (501, LONG, None, None)]
    df = table(spark, rows + long)
    model = toxicity.train(df, labels, sample_bytes=100_000)
    found = {x["id"]: x["score"] for x in toxicity.score(clashing(df).drop("id"), model).collect()}
    assert all((found[k] >= 0.7) == (k % 3 == 0) for k in range(120)) and len(found) == 122
    again = toxicity.train(df.repartition(5), labels, sample_bytes=100_000)
    assert (again.weights == model.weights).all()
    empty = toxicity.train(table(spark, []), labels.limit(0))
    assert toxicity.score(table(spark, []), empty).count() == 0 and toxicity.score(table(spark), empty).count() == len(ROWS)


def test_rare_grams_of_urls(spark, monkeypatch):
    """Weights that are not broadcast count as well."""
    urls = [(k, f"http://h{k % 7}.{'org/fr/' if k % 2 else 'net/'}p{k}") for k in range(60)] + [(100 + k, f"http://x.com/p{k}") for k in range(20)] + [(None, None), (None, None)]
    df = spark.createDataFrame(urls, "page_id long, url string").select("*", F.lit(0).alias("row"), F.lit("x").alias("gram"))
    want = sorted(map(str, url_filter.judge(df).collect()))
    monkeypatch.setattr(url_filter, "FREQUENT", 5)
    assert sorted(map(str, url_filter.judge(df).collect())) == want and len(want) == len(urls)


def random_edit(r, words, rate):
    out = []
    for w in words:
        if r.random() >= rate:
            out.append(w)
        else:
            out += r.choice([["zz"], [], [w, "zz"]])
    return out


def matched(a, b):
    """Words matched by the best local alignment (match 2, others -1), of equal scores the most."""
    row, best = [(0, 0)] * (len(b) + 1), (0, 0)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b, 1):
            s, m = row[j - 1]
            t = max((s + 2, m + 1) if x == y else (s - 1, m), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1]))
            new.append(t if t[0] > 0 else (0, 0))
            best = max(best, new[-1])
        row = new
    return best[1]


@pytest.mark.parametrize("copy_rate", [0.005, 0.05])
def test_decontamination_recall(spark, copy_rate):
    """Edited copies at many edit and copy rates, held to the alignment of every document with every item."""
    r = random.Random(21)
    items = [[f"w{r.randint(0, 3000)}" for _ in range(n)] for n in (8, 15, 25, 40)]
    rows = []
    for _ in range(400):
        w = [f"p{r.randint(0, 500)}" for _ in range(30)]
        for item in items:
            if r.random() < copy_rate * 4:
                w[15:15] = random_edit(r, item, r.choice([0, 0.05, 0.1, 0.15, 0.2]))
        rows.append(w)
    want = {(k, n) for k, w in enumerate(rows) for n, item in enumerate(items) if len(set(w) & set(item)) > 3 and matched(item, w) >= 0.8 * len(item) - 1e-9}
    df = table(spark, [(k, " ".join(w), None, None) for k, w in enumerate(rows)])
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(df, bench).collect()}
    assert found <= want and len(found) >= 0.95 * len(want) and want


def test_pipeline_on_odd_rows(spark, bench, tmp_path):
    clashing(table(spark)).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count() > 0
    table(spark, []).write.parquet(f"{tmp_path}/empty/documents.parquet")
    bench.write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_encoder_forgets_and_stays_right(monkeypatch):
    """Words' ids are right whether they are remembered, forgotten, or beside the sorted ones."""
    r = random.Random(5)
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join("".join(r.choice("abcé'") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 60))) for _ in range(80)] + [LONG]
    encoder = wavelet.Encoder(path)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.dtype).tobytes() + b"ee" for t in texts]
    for most in (0, 40, 10**6):
        monkeypatch.setattr(wavelet, "REMEMBERED", most)
        encoder = wavelet.Encoder(path)
        for at in range(0, len(texts), 7):
            assert encoder.encode([t.encode() for t in texts[at : at + 7]], b"ee") == want[at : at + 7]
    memory = wavelet.Memory(np.dtype("<u2"))
    held = {}
    for _ in range(40):
        keys = np.setdiff1d(np.array([r.getrandbits(64) for _ in range(4000)], np.uint64), np.array(list(held), np.uint64))
        size = np.array([r.randint(0, 3) for _ in keys])
        ids = np.array([r.getrandbits(16) for _ in range(size.sum())], np.uint16)
        memory.add(keys, ids, size)
        held |= {k: x.tolist() for k, x in zip(keys.tolist(), np.split(ids, np.cumsum(size)[:-1]), strict=True)}
    some = np.array([*r.sample(list(held), 500), 1, 2, 3], np.uint64)
    begin, size = memory.find(some)
    assert size[-3:].tolist() == [-1] * 3 and len(memory) == len(held)
    assert all(memory.pool[b : b + n].tolist() == held[k] for k, b, n in zip(some[:-3].tolist(), begin.tolist(), size.tolist(), strict=False))
