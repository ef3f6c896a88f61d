"""URL filter: rules first, else a ratio of two character language models; DataFrame operations only.

URLs that an allow rule decides train the accepted model, those of a block rule
the rejected one.  Each is a variable-order Markov model over characters with
begin and end marks: every context of up to ``order`` characters and every n-gram that occurs is
held, whatever the number of URLs, and orders are interpolated by Witten-Bell.  Since log p(c | long) is the sum
over orders of log p_k - log p_(k-1), a URL's log-likelihood difference is a plain
sum of one weight per n-gram occurrence, so scoring is a join and one
sum.  The FREQUENT n-grams that occur most often are joined by broadcast (some 30 MB at most), so no key of
the shuffled join of the others is hot.  The difference over the length is held against a threshold
calibrated on a fifth of the ruled URLs, which neither model has seen.

Defined cases: a null URL, or one without "://", has empty host and path, fits
no rule and is scored as its text (null: empty; the end mark is always scored);
with no rejected example everything else is allowed, with no accepted one it is
blocked; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: N-grams whose weights are broadcast.
FREQUENT = 1 << 18
#: Characters of a URL that are cut up at once.
PART = 256
#: (verdict, host with path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BEGIN, END = "\u0002", "\u0003"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return store.ascii_lower(host), path


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule's text, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _grams(urls: DataFrame, order: int, *by: str) -> DataFrame:
    """(by, size, gram) for every n-gram occurrence of ``url``, marks included."""
    marks = urls.select(*by, F.concat(F.array(F.lit(BEGIN)), F.split(F.col("url"), ""), F.array(F.lit(END))).alias("raw"))
    marks = marks.select(*by, F.filter("raw", lambda c: c != "").alias("c"))
    # a very long URL is cut into parts that overlap by the order, as a slice may copy its whole array
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(c) - 1) div {PART}")), lambda p: F.struct(F.greatest(p * PART - order, F.lit(0)).alias("base"), (p * PART).alias("own"), F.slice(F.col("c"), F.greatest(p * PART - order, F.lit(0)) + 1, F.lit(PART + order)).alias("c")))
    cut = marks.select(*by, F.explode(parts).alias("p")).select(*by, F.col("p.c").alias("c"), F.col("p.base").alias("base"), F.col("p.own").alias("own"))
    tails = F.transform("c", lambda _, i: F.slice(F.col("c"), F.greatest(i - F.lit(order - 1), F.lit(1)), F.least(i + 1, F.lit(order + 1))))
    ends = cut.select(*by, "base", "own", F.posexplode(tails).alias("place", "tail")).select(*by, "own", (F.col("base") + F.col("place")).alias("at"), "tail")
    # a place belongs to the part that starts at or before it, the last such
    ends = ends.filter(F.col("at").between(F.col("own"), F.col("own") + PART - 1))
    sizes = F.explode(F.expr("sequence(1, size(tail))"))
    return ends.select(*by, "at", "tail", sizes.alias("size")).select(*by, "at", "size", F.array_join(F.expr("slice(tail, size(tail) - size + 1, size)"), "").alias("gram"))


def train(labelled: DataFrame, order: int = 4) -> tuple[DataFrame, DataFrame]:
    """From (url, accepted): weights (gram, weight, n), accepted minus rejected, with the occurrences, and (start), the weight of every position."""
    # an n-gram predicts its last character; the begin mark is never predicted
    counts = store.keep(_grams(labelled, order, "accepted").filter("at > 0").groupBy("accepted", "size", "gram").agg(F.count("*").alias("n")), "grams")
    totals = counts.filter("size = 1").groupBy("accepted").agg(F.sum("n").alias("positions"), F.count("*").alias("alphabet"))
    counts = counts.join(F.broadcast(totals), "accepted").withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    contexts = store.keep(counts.filter("size > 1").groupBy("accepted", "context").agg(F.sum("n").alias("n_context"), (F.count("*") + 1).alias("kinds")), "contexts")
    grams = counts
    floor = F.lit(1.0) / (F.col("positions") + F.col("alphabet") + 1)
    level = grams.filter("size = 1").select("accepted", "gram", ((F.col("n") + 1) * floor).alias("p"), F.log((F.col("n") + 1).cast("double")).alias("w"))
    weights = [grams.filter("size = 1").join(level, ["accepted", "gram"]).select("accepted", "gram", "w", "n")]
    for size in range(2, order + 2):
        lower = level.select("accepted", F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        here = grams.filter(F.col("size") == size).join(contexts, ["accepted", "context"]).withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, ["accepted", "suffix"])
        seen = (F.col("n") / F.col("p_lower") + F.col("kinds")) / F.col("kinds")
        level = store.keep(here.select("accepted", "gram", ((F.col("n") + F.col("kinds") * F.col("p_lower")) / (F.col("n_context") + F.col("kinds"))).alias("p"), F.log(seen).alias("w"), "n"), f"order{size}")
        weights.append(level.select("accepted", "gram", "w", "n"))
    weights.append(contexts.select("accepted", F.col("context").alias("gram"), F.log(F.col("kinds") / (F.col("n_context") + F.col("kinds"))).alias("w"), F.lit(0).cast("long").alias("n")))
    both = weights[0]
    for w in weights[1:]:
        both = both.unionByName(w)
    sign = F.when(F.col("accepted"), 1.0).otherwise(-1.0)
    return store.keep(both.groupBy("gram").agg(F.sum(F.col("w") * sign).alias("weight"), F.sum("n").alias("n")), "weights"), totals.select(F.sum(F.log(floor) * sign).alias("start"))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, order: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log-likelihood difference per character), threshold."""
    host, path = split_url(F.col(url_col))
    verdict_of = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]) if rules else F.create_map().cast("map<string,string>")
    split = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", match_rule(F.col("host"), F.col("path"), rules))
    ruled = store.keep(ruled.withColumn("ruled", verdict_of[F.col("rule")]).withColumn("fold", store.fold(F.col("page_id"), 5)).withColumn("row", F.monotonically_increasing_id()), "urls")
    weights, start = train(ruled.filter("ruled IS NOT NULL AND fold <> 0").select(store.ascii_lower(F.col("url")).alias("url"), (F.col("ruled") == "allow").alias("accepted")), order)
    often = store.keep(weights.orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram", "weight"), "often")
    rare = weights.join(F.broadcast(often.select("gram")), "gram", "left_anti").select("gram", F.col("weight").alias("rare"))
    met = _grams(ruled.select("row", store.ascii_lower(F.col("url")).alias("url")), order, "row").join(F.broadcast(often), "gram", "left")
    met = met.groupBy("row", F.when(F.col("weight").isNull(), F.col("gram")).alias("gram")).agg(F.sum("weight").alias("sum"), F.count("*").alias("times"))
    met = store.keep(met, "met")
    others = met.filter("gram IS NOT NULL").join(rare, "gram").select("row", (F.col("rare") * F.col("times")).alias("sum"))
    sums = met.filter("gram IS NULL").select("row", "sum").unionByName(others).groupBy("row").agg(F.sum("sum").alias("sum"))
    length = F.length("url") + 1
    per_char = F.round(F.coalesce((F.coalesce(F.col("sum"), F.lit(0.0)) + length * F.col("start")) / length, F.lit(0.0)), 9)
    scored = store.keep(ruled.join(sums, "row", "left").join(F.broadcast(start)).select(*ruled.columns, per_char.alias("score")), "scores")
    held = scored.filter("ruled IS NOT NULL AND fold = 0").groupBy().agg(
        *[f(F.when(F.col("ruled") == v, F.col("score"))).alias(f"{n}_{v}") for n, f in (("mean", F.avg), ("sd", F.stddev_pop)) for v in ("allow", "block")]
    )
    have = ruled.groupBy().agg(F.sum((F.col("ruled") == "allow").cast("int")).alias("accepts"), F.sum((F.col("ruled") == "block").cast("int")).alias("rejects"))
    # between the classes' means, nearer to the narrower one; 0 if a class has no held-out example
    sds = F.col("sd_allow") + F.col("sd_block") + 2e-6
    middle = F.coalesce((F.col("mean_allow") * (F.col("sd_block") + 1e-6) + F.col("mean_block") * (F.col("sd_allow") + 1e-6)) / sds, F.lit(0.0))
    limits = held.join(have).select(F.when(F.coalesce("rejects", F.lit(0)) == 0, F.lit(float("-inf"))).when(F.coalesce("accepts", F.lit(0)) == 0, F.lit(float("inf"))).otherwise(F.round(middle, 9)).alias("threshold"))
    by_model = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return scored.join(F.broadcast(limits)).select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", "threshold")
