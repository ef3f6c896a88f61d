"""Exact dedup, mixing and the URL filter on small tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from syntenia.llm import exact_dedup, mixing, queries, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    return spark.createDataFrame([(k, t, None, f"s{k % 3}" if k % 7 else None, 0) for k, t in enumerate(texts)], DOC)


TEXTS = ["The cat", "the CAT", None, "", "É", "é", "the cat ", "x" * 200_000, "X" * 200_000, "a b c"] * 3


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    digest = (lambda c: F.substring(c, 1, 1)) if weak else F.md5  # a digest with collisions: bytes tell them apart
    df = docs(spark, TEXTS).withColumn("h", F.lit(1)).withColumn("norm", F.lit("clash"))
    found = {r["doc_id"]: r for r in exact_dedup.exact_groups(df, keep="largest", digest=digest).collect()}
    norm = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") for t in TEXTS]
    groups = defaultdict(list)
    for k, t in enumerate(norm):
        groups[t].append(k)
    for k, t in enumerate(norm):
        r = found[k]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(groups[t]), len(groups[t]), k == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.drop_exact(docs(spark, TEXTS)).count() == len(groups)
    assert exact_dedup.exact_groups(docs(spark, TEXTS).limit(0)).count() == 0


def test_queries_equal_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        found, expect = queries.queries()[name](spark, d).toPandas(), con.sql(sql).df()
        key = sorted(found.columns)
        assert key == sorted(expect.columns)
        a, b = (x[key].sort_values("doc_id").reset_index(drop=True).astype(str) for x in (found, expect))
        assert a.equals(b), name


def test_targets_fill_like_water(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), (None, 500), ("d", 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight, left = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(order)}, 1.5 * sum(n for _, n in rows)
    want, free = {}, dict(order)
    while free:  # the excess is shared out again until none is above
        level = left / sum(weight[s] for s in free)
        over = [s for s, n in free.items() if weight[s] * level > 2 * n]
        if not over:
            want |= {s: weight[s] * level for s in free}
            break
        for s in over:
            want[s] = 2.0 * free.pop(s)
            left -= want[s]
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in want)


def test_mixture_meets_targets(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(k, " ".join(["w"] * r.randint(0, 40)), None, f"s{min(3, k % 9)}", 0) for k in range(900)], DOC)
    rows = mixing.mixture(df).collect()
    by = defaultdict(list)
    for x in rows:
        by[x["source"]].append(x)
        assert x["taken"] in (0, x["size"], 2 * x["size"])
    for own in by.values():
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 20 and own[0]["source_size"] == sum(x["size"] for x in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(df.repartition(7)).collect()))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and Counter(x["doc_id"] for x in mixed.collect()) == {x["doc_id"]: x["copies"] for x in rows if x["taken"]}


def test_mixture_edges(spark):
    assert mixing.mixture(docs(spark, TEXTS).limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mixture(docs(spark, [None, "", " \t"])).collect()} == {0}
    odd = docs(spark, ["a b"] * 6).withColumn("doc_id", F.lit(None).cast("long")).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    assert mixing.mixture(odd).count() == 6
    weighted = docs(spark, ["a b c"] * 300).withColumn("q", F.when(F.col("doc_id") < 150, 3).otherwise(1))
    rows = mixing.mixture(weighted, weight_col="q").collect()
    assert sum(r["taken"] for r in rows if r["doc_id"] < 150) > sum(r["taken"] for r in rows if r["doc_id"] >= 150)


URLS = ["http://a.example.net/en/1", "http://a.example.net/fr/1", "https://EXAMPLE.com/de/x?q=1", "http://b.example.com/de", "http://x.org/fr/", "http://x.org/en/1#f", "no scheme", None, "", "ftp://net", "http://net/", "http://example.network/en/", "x://u:p@h.org:80/fr/é?/en/", "http://spam.example.com/en/buy"]


def test_rules(spark):
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))).orderBy("page_id").collect()
    assert [r["rule"] for r in rows] == ["example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, "net/", None, None, None]
    assert [(r["host"], r["path"]) for r in rows][2:9] == [("example.com", "/de/x"), ("b.example.com", "/de"), ("x.org", "/fr/"), ("x.org", "/en/1"), ("", ""), ("", ""), ("", "")]
    assert rows[12]["host"] == "u:p@h.org:80" and all(r["verdict"] in ("allow", "block") for r in rows)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    only = url_filter.judge(spark.createDataFrame([(1, "http://x.org/fr/"), (2, "http://y.com/")], "page_id long, url string"))
    assert {r["verdict"] for r in only.collect()} == {"allow"}


def brute_weights(urls, order):
    """log p of each class by the recursion in the docstring, everything kept."""
    def chars(u):
        return [url_filter.BEGIN, *u, url_filter.END]

    n = Counter()
    for u in urls:
        c = chars(u)
        for i in range(1, len(c)):
            for k in range(1, order + 2):
                if i - k + 1 >= 0:
                    n["".join(c[i - k + 1 : i + 1])] += 1
    positions, alphabet = sum(v for g, v in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    ctx, kinds = Counter(), Counter()
    for g, v in n.items():
        if len(g) > 1:
            ctx[g[:-1]] += v
            kinds[g[:-1]] += 1

    def p(context, s):
        if not context:
            return (n[s] + 1) / (positions + alphabet + 1)
        if context not in ctx:
            return p(context[1:], s)
        t = kinds[context] + 1
        return (n[context + s] + t * p(context[1:], s)) / (ctx[context] + t)

    return lambda u: sum(math.log(p("".join(chars(u)[max(0, i - order) : i]), chars(u)[i])) for i in range(1, len(u) + 2))


def test_scores_equal_the_recursion(spark):
    r = random.Random(2)
    pages = [(k, f"http://{r.choice('abc')}{r.choice(['.org/fr/', '.net/', '.example.com/de/', '.com/'])}{r.randint(1, 50)}") for k in range(120)]
    pages += [(200 + k, f"http://a{'.org/fr/' if k % 2 else '.com/'}" + "".join(r.choice("abc/") for _ in range(500 + 13 * k))) for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = {x["page_id"]: x for x in url_filter.judge(df, order=3).collect()}
    import zlib

    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    score = {}
    for v in ("allow", "block"):
        score[v] = brute_weights([u for k, u in pages if rows[k]["rule"] and rows[k]["verdict"] == v and fold(k)], 3)
    for k, u in pages:
        assert abs(rows[k]["score"] - (score["allow"](u) - score["block"](u)) / (len(u) + 1)) < 1e-6
