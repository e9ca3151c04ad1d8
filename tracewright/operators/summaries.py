"""Figures of pages, drawings, selections, searches and score sheets. Tables are keyed by (doc, page); empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import match_rank
from .graph import KEY


def _n(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(*KEY).agg(F.count("*").alias(name))


def page_summary(pages: DataFrame, wires: DataFrame, nets: DataFrame, dots: DataFrame, texts: DataFrame, glyphs: DataFrame, most: int | None = 40) -> DataFrame:
    """One row for each of ``pages`` (doc, page): wires, nets, named nets, dots, texts, kinds (a map from kind to count), unattached (nets outside bodies that name no wire), loose (the first ``most`` of them, or all, by text_id) and
    vector_text: more than 0.8 glyphs drawn as strokes (glyphs: doc, page, prim_id) for each text. ``nets``: name; ``texts``: text_id, str, kind, in_body, net_id. Pages without rows count 0."""
    kinds = texts.groupBy(*KEY, "kind").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("kind", F.lit("")).alias("k"), "n")))).alias("kinds"), F.sum("n").alias("texts"))
    free = texts.where((F.col("kind") == "net") & ~F.coalesce("in_body", F.lit(False)) & F.col("net_id").isNull())
    first = free.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("text_id"))).where(F.lit(True) if most is None else F.col("r") <= most)
    first = first.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "str"))), lambda x: x["str"]).alias("loose"))
    named = nets.groupBy(*KEY).agg(F.count("*").alias("nets"), F.count_if(F.col("name") != "").alias("named"))
    out = pages.select(*KEY).distinct()
    for d in (_n(wires, "wires"), named, _n(dots, "dots"), kinds, _n(free, "unattached"), first, _n(glyphs, "glyphs")):
        out = out.join(d, KEY, "left")
    out = out.fillna(0, ["wires", "nets", "named", "dots", "texts", "unattached", "glyphs"])
    empty = F.create_map().cast("map<string,bigint>")
    return out.withColumns({"kinds": F.coalesce("kinds", empty), "loose": F.coalesce("loose", F.array().cast("array<string>")), "vector_text": F.col("glyphs") > F.col("texts") * 0.8}).drop("glyphs")


def doc_summary(nets: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc, names, parts, unnamed): distinct names of nets in any case, distinct references (parts: doc, ref), nets without a name that have two segments or more. Drawings with either have a row."""
    a = nets.groupBy("doc").agg(F.count_distinct(F.when(F.col("name") != "", F.upper("name"))).alias("names"), F.count_if((F.col("name") == "") & (F.col("n_segs") > 1)).alias("unnamed"))
    b = parts.groupBy("doc").agg(F.count_distinct("ref").alias("parts"))
    return a.join(b, "doc", "full_outer").fillna(0).select("doc", "names", "parts", "unnamed")


def net_selection(nets: DataFrame, wires: DataFrame, labels: DataFrame, dots: DataFrame) -> DataFrame:
    """(doc, page, key, nets, segs, dots, labels): what choosing a name (key, in upper case) selects on a page; labels are (str, n), most frequent first, equal ones as they first come by net and text.
    ``wires``, ``dots`` (net_id) and ``labels`` (net_id, text_id, str) of nets without a name are left out."""
    named = nets.where("name <> ''").select(*KEY, "net_id", F.upper("name").alias("key"))
    on = lambda d, n: d.join(named, [*KEY, "net_id"]).groupBy(*KEY, "key").agg(F.count("*").alias(n))
    said = labels.join(named, [*KEY, "net_id"]).groupBy(*KEY, "key", "str").agg(F.count("*").alias("n"), F.min(F.struct("net_id", "text_id")).alias("at"))
    said = said.groupBy(*KEY, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "at", "str"))), lambda x: F.struct(x["str"].alias("str"), (-x["less"]).alias("n"))).alias("labels"))
    out = named.groupBy(*KEY, "key").agg(F.count("*").alias("nets")).join(on(wires, "segs"), [*KEY, "key"], "left").join(on(dots, "dots"), [*KEY, "key"], "left").join(said, [*KEY, "key"], "left")
    return out.fillna(0, ["segs", "dots"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<struct<str:string,n:bigint>>")))


def search(items: DataFrame, queries: list[str], by: list[str]) -> DataFrame:
    """``items`` (by ..., place, names: the words that each goes by) that answer each of a few ``queries``, with rank (0 equal, 1 starts with it, 2 holds it; the best of an item's names), exact (how many items of the list
    equal it) and hit: their order, best ranks first, within a rank as listed (place). Case and outer blanks of a query do not count; an empty query has no answers."""
    asked = [q.strip() for q in queries if q.strip()]
    q = F.explode(F.array(*[F.lit(x) for x in asked]).cast("array<string>")).alias("query")
    j = items.select("*", q).withColumn("rank", F.array_min(F.transform("names", lambda x: match_rank(x, F.col("query"))))).where("rank is not null")
    w = Window.partitionBy(*by, "query")
    return j.withColumns({"hit": F.row_number().over(w.orderBy("rank", "place")), "exact": F.count_if(F.col("rank") == 0).over(w)})


def score_summary(scores: DataFrame, metrics: list[str], totals: list[str]) -> DataFrame:
    """(doc, page, metrics, totals): the score sheet of the pages with true wires (wire_precision is not null), and in the row without doc and page the mean of each metric over the pages that define it
    (neither null nor NaN) and the sums of the ``totals``."""
    known = [F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics]
    s = scores.where("wire_precision is not null")
    return s.groupingSets([[F.col("doc"), F.col("page")], []], "doc", "page").agg(*known, *[F.sum(t).alias(t) for t in totals])
