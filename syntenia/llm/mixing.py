"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

A source's target is its weight's part of ``share`` times all words, stopped at
``cap`` times the source's words, the excess going to the others by weight.
Target over size is the number of copies each document may expect.  Its whole
part is allocated for certain; the rest is the inclusion probability p, and
documents are ranked by (u/(1-u)) / (p/(1-p)) with u uniform from a hash of the
id.  In that order documents enter until the source's word budget is met, the
last one if that comes nearer, so a source misses its target by at most half the
size of one document.

Plan.  No source is ever sorted as a whole: ranks are radix-selected.  Words are
summed by (source, 1/4096 of the rank range), the range that holds the budget is
split again by 4096, and only the rows of that last cell are ordered.

Defined cases: null text has size 0 and takes nothing; sources order by code
point, a null source last; rows of one source with the same id (ties, repeats, null ids;
ids may be of any type that has an order) get the same rank and decision, taken together if that
comes nearer; empty tables give empty results; sizes of 0 all over
give targets of 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store

CELLS = 4096
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares, stopped at cap and reshared."""
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    filled = (
        sizes.withColumn("n", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, ((F.col("n") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("height", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "n", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("height").isNull() | (F.col("ratio") <= F.col("height")), F.col("most")).otherwise(F.col("weight") * F.col("height"))
    return filled.select("source", "source_size", target.alias("target"))


def _uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _sized(docs: DataFrame, *more: Column, seed: int, weight_col: str | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, u, boost) of each row, and more columns."""
    boost = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(store.WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), _uniform(F.col(id_col), seed).alias("u"), boost.alias("boost"), *more)


def _ranked(base: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """``base`` with its source's plan, the document's whole copies, and its rank for one more."""
    return (
        base.join(store.small(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("expected", F.least(F.col("rate") * F.col("boost"), F.lit(float(cap))))
        .withColumn("whole", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .withColumn("odds", F.col("u") * (1 - F.col("p")))
        .withColumn("against", F.col("p") * (1 - F.col("u")))
        .withColumn("rank", F.when(F.col("p") > 0, F.col("odds") / (F.col("odds") + F.col("against"))))
        .withColumn("cell1", F.floor(F.col("rank") * CELLS))
        .withColumn("cell2", F.floor(F.col("rank") * CELLS * CELLS))
        .withColumn("place", F.struct("rank", F.col("doc_id").alias("tie")))
    )


def _planned(base: DataFrame, weights: Sequence[float], share: float, cap: float) -> tuple[DataFrame, DataFrame]:
    """By source: (source, source_size, target, rate), and (c, cut_cell, cut), the last place that enters.  Both have a row for each source."""
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("boost")).alias("boosted"))
    rate = F.when(F.col("boosted") > 0, F.col("target") / F.col("boosted")).otherwise(F.lit(0.0))
    targeted = targets(sizes.select("source", "source_size"), weights, share, cap)
    joined = targeted.join(sizes.select(F.col("source").alias("s"), "boosted"), F.col("source").eqNullSafe(F.col("s")))
    plan = store.keep(joined.select("source", "source_size", "target", rate.alias("rate")), "targets")
    ranked = _ranked(base, plan, cap)
    # the budget left after whole copies, and where it runs out: first among 4096 cells, then among 4096 parts of one cell
    budget = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("budget")).withColumnRenamed("source", "b")

    def edge(rows: DataFrame, cell: str, start: Column) -> DataFrame:
        """Per source the cell within which the budget is met, with the words before it."""
        w = W.partitionBy("source").orderBy(cell).rowsBetween(W.unboundedPreceding, 0)
        sums = rows.groupBy("source", cell).agg(F.sum("size").alias("part"), F.first(start).alias("start"), F.first("budget").alias("budget"))
        c0 = F.col("start") + F.sum("part").over(w) - F.col("part")
        return sums.withColumn("c0", c0).filter("c0 <= budget AND c0 + part > budget").select(F.col("source").alias("e"), F.col(cell).alias("e_cell"), F.col("c0").alias("e_c0"))

    open_rows = ranked.filter("rank IS NOT NULL").select("source", "size", "place", "cell1", "cell2").join(budget, F.col("source").eqNullSafe(F.col("b"))).drop("b")
    first = edge(open_rows, "cell1", F.lit(0))
    inside = open_rows.join(first, F.col("source").eqNullSafe(F.col("e")) & (F.col("cell1") == F.col("e_cell"))).drop("e", "e_cell").withColumnRenamed("e_c0", "before")
    second = edge(inside, "cell2", F.col("before"))
    cell = inside.join(second, F.col("source").eqNullSafe(F.col("e")) & (F.col("cell2") == F.col("e_cell")))
    # rows of one place (equal ids) enter together
    cell = cell.groupBy("source", "cell2", "place", "e_c0", "budget").agg(F.sum("size").alias("size"))
    along = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    fits = F.col("e_c0") + F.sum("size").over(along) - F.col("size") / 2 <= F.col("budget")
    cut = cell.withColumn("fits", fits).groupBy(F.col("source").alias("c")).agg(F.first("cell2").alias("cut_cell"), F.max(F.when(F.col("fits"), F.col("place"))).alias("cut"))
    return plan, store.keep(cut, "cuts")


def _taken(ranked: DataFrame, cut: DataFrame) -> DataFrame:
    """``ranked`` with copies."""
    inside = (F.col("cell2") == F.col("cut_cell")) & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
    enters = F.col("rank").isNotNull() & (F.col("cut_cell").isNull() | (F.col("cell2") < F.col("cut_cell")) | inside)
    return ranked.join(store.small(cut), F.col("source").eqNullSafe(F.col("c")), "left").withColumn("copies", (F.col("whole") + enters.cast("long")).cast("long"))


def mixture(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source, pareto_rank.

    ``weight_col`` makes inclusion within a source unequal: expected copies are
    in proportion to it (stopped at ``cap``), their word-weighted mean being the
    source's.  Null weights count as 0.
    """
    base = store.keep(_sized(docs, seed=seed, weight_col=weight_col, id_col=id_col, text_col=text_col, source_col=source_col), "sizes")
    plan, cut = _planned(base, weights, share, cap)
    return _taken(_ranked(base, plan, cap), cut).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "source", F.col("rank").alias("pareto_rank")
    )


def mix(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0, weight_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as :func:`mixture` says; rows of no words go."""
    names = dict(seed=seed, weight_col=weight_col, id_col=id_col, text_col=text_col, source_col=source_col)
    base = store.keep(_sized(docs, **names), "sizes")
    plan, cut = _planned(base, weights, share, cap)
    store.drop(base)
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    taken = _taken(_ranked(_sized(docs, whole, **names), plan, cap), cut).filter("size > 0 AND copies > 0")
    many = taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return many.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
