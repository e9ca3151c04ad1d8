"""Mixing sources to target weights by subset-sum budget fitting.

Targets follow from source weights and sizes. Each source is taken whole as often as its target allows; for the rest of the budget,
documents are counted by their exact length, an even share of every length is taken for all but the last words, and a bounded-knapsack dynamic
program over the lengths fills those. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Weights by order of the sources, share of all words that the mix holds, most passes over a source.
WEIGHTS, SHARE, PASSES, SEED = (3, 1, 2), 1.5, 2, 11
#: Most words that the dynamic program fills; ranks are counted in buckets of about this many documents.
BUDGET, BUCKET = 1 << 17, 64


def n_words(text: Column) -> Column:
    """The number of words (runs of characters other than blank and \\x09-\\x0D) of the whole text; null: 0."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def fit_counts(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take (0..count) so that their words come nearest to ``budget``. All but the last BUDGET / 2 words
    are an even share of every length; the program over bounded counts finds the sum of what is left nearest to the rest."""
    order = np.argsort(length)
    length, count = length[order].astype(np.int64), count[order].astype(np.int64)
    total = int((length * count).sum())
    take = count.copy()
    if budget < total:
        take = np.floor(count * (max(0, budget - BUDGET // 2) / total)).astype(np.int64)
        rest = budget - int((take * length).sum())
        for i in range(len(length) - 1, -1, -1):  # what rounding left over, longest first, until the program can hold it
            if rest > BUDGET:
                more = min(int(count[i] - take[i]), max(0, (rest - BUDGET // 2) // max(int(length[i]), 1)))
                take[i] += more
                rest -= more * int(length[i])
        rest = min(rest, BUDGET)
        items, top = [], rest + min(int(length[-1]), BUDGET)  # (length index, copies), each used at most once: binary parts of what is left
        for i in range(len(length)):
            spare, k = min(int(count[i] - take[i]), top // max(int(length[i]), 1)), 1
            while length[i] and spare > 0:
                items.append((i, min(k, spare)))
                spare -= k
                k *= 2
        items = [items[i] for i in np.random.default_rng(SEED).permutation(len(items))]
        by = np.full(top + 1, -1, np.int32)  # the item that first reached each sum
        reached = np.zeros(top + 1, bool)
        reached[0] = True
        for n, (i, k) in enumerate(items):
            w = int(length[i]) * k
            if w <= top:
                new = np.flatnonzero(reached[: top + 1 - w] & ~reached[w:]) + w
                reached[new] = True
                by[new] = n
            if reached[rest]:
                break
        sums = np.flatnonzero(reached)
        at = int(sums[np.abs(sums - rest).argmin()])
        while at:
            i, k = items[by[at]]
            take[i] += k
            at -= int(length[i]) * k
    out = np.empty_like(take)
    out[order] = take
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken = size x copies; old columns of these names are replaced.
    The text itself is dropped unless ``with_text``.

    ``docs`` has doc_id and source. Sources are ordered by code point, null last (one source of its own). copies is 0..passes. Documents without words cost nothing
    and are in as many passes as their source is taken whole, once at least. Ties are broken by a seeded hash of id and text, then the id, then a hash of the text;
    rows with both equal are documents of their own that nothing tells apart. The same rows give the same mix. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ("size", "source_size", "target", "copies", "taken")
    kept = docs.select([c for c in docs.columns if c not in new])
    names = [c for c in kept.columns if with_text or c != text_col]
    own = {"doc_id", "source", text_col}
    kept = kept.select([F.col(f"`{c}`").alias(c if c in own else f"__c{i}") for i, c in enumerate(kept.columns)])  # no other name of docs is met below
    sized = kept.withColumns({"__t": F.xxhash64(text_col), "size": n_words(F.col(text_col))})
    sized = written(sized if with_text else sized.drop(text_col), "sizes")
    by_length = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    total = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = _targets(spark, total, weights, share, passes)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        words, target = int(rows["words"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(passes, int(target // words)) if words else 1
        left = int(round(target - whole * words)) if whole < passes and words else 0
        extra = fit_counts(rows["size"].to_numpy(), np.where(rows["size"] > 0, rows["n"], 0), left)
        return rows.assign(whole=np.where(rows["size"] > 0, whole, max(whole, 1)), extra=extra)

    lengths = by_length.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    plans = written(lengths.groupBy("source").applyInPandas(plan, "source string, size long, n long, words long, target double, whole long, extra long"), "plan")
    p = plans.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), *[F.col(c).alias(f"__{c}") for c in ("n", "words", "target", "whole", "extra")])
    d = sized.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    d = d.withColumn("__h", F.xxhash64("doc_id", "__t", F.lit(seed)))
    settled = d.where("__extra = 0 or __extra = __n").withColumn("__copies", F.col("__whole") + (F.col("__extra") > 0).cast("long"))
    # The extra documents of a length are those with the smallest hashes: buckets of the hash range are counted, and only within the
    # bucket where the count is reached are documents ranked; no length is gathered whole.
    o = d.where("__extra > 0 and __extra < __n").withColumn("__b", F.floor((F.shiftrightunsigned("__h", 1) / F.lit(float(1 << 63))) * F.ceil(F.col("__n") / BUCKET)))
    o = o.withColumns({"__s": F.coalesce("source", F.lit("")), "__z": F.col("source").isNull()})
    counts = o.groupBy("__s", "__z", "size", "__b").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy("__s", "__z", "size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__s", "__z", "size", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    o = o.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__z", "size", "__b").orderBy("__h", "doc_id", "__t")))
    o = o.join(counts, ["__s", "__z", "size", "__b"])
    ranked = o.withColumn("__copies", F.col("__whole") + (F.col("__before") + F.col("__r") <= F.col("__extra")).cast("long"))
    copies = F.col("__copies")
    cols = [*[c for c in sized.columns if c not in ("size", "__t")], "size", F.col("__words").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return settled.select(cols).unionByName(ranked.select(cols)).toDF(*names, *new)


def _targets(spark, total: DataFrame, weights, share: float, passes: int) -> DataFrame:
    """(goal_source, words, target), sources in order. A running order over the sources (aggregated rows, not documents) gives weights;
    targets above ``passes`` sizes are settled round by round, each round one aggregate."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = written(total.withColumn("w", w), "sources")
    budget = share * float(rows.agg(F.sum("words")).first()[0] or 0)
    # A source is over its limit if level x weight > passes x size: sort sources by size / weight and find where the level stands.
    level, done = None, False
    while not done:
        cap = F.lit(False) if level is None else F.col("w") * level > F.col("words") * passes
        a = rows.agg(F.sum(F.when(cap, F.col("words") * passes).otherwise(0.0)).alias("fixed"), F.sum(F.when(cap, 0.0).otherwise(F.col("w"))).alias("free")).first()
        new = (budget - (a["fixed"] or 0.0)) / a["free"] if a["free"] else None
        done = new is None or new == level
        level = level if new is None else new
    target = F.least(F.col("w") * F.lit(float(level or 0)), F.col("words") * float(passes))
    return rows.select(F.col("source").alias("goal_source"), "words", target.alias("target"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them: all columns of ``docs``, a document that is taken twice in two rows. Documents without words stay."""
    new = mix(docs, with_text=True, **how)
    return new.where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select([F.col(f"`{c}`") for c in docs.columns])
