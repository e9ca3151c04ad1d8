"""The netlist that some tools leave in a drawing's bookmark tree. ``outline``: doc, node, parent (null at the top), title, page. Nodes are numbered in reading order; page is that of the node's target, null or
below 0 if there is none. Titles may carry a trailing count. An empty tree and null titles give nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import strip_count

NODE = ["doc", "node"]


def _first_child(outline: DataFrame, title: str) -> DataFrame:
    """(doc, node, parent): the first child of this title of every node that has one."""
    named = outline.where(F.btrim(strip_count(F.col("title"))) == title)
    return named.where(F.col("parent").isNotNull()).groupBy("doc", "parent").agg(F.min("node").alias("node"))


def _children(outline: DataFrame, of: DataFrame, *keep: str) -> DataFrame:
    """(doc, node, title, ...): the children of the nodes ``of``, with its columns ``keep``."""
    own = of.select("doc", F.col("node").alias("parent"), *keep)
    return outline.select("doc", "parent", "node", F.btrim(F.col("title")).alias("title")).join(own, ["doc", "parent"]).select("doc", "node", "title", *keep)


def _branches(outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Branches Nets and Components (doc, node, sheet, page) of all sheets: nodes outside such branches that own one and lead to a page."""
    nets, parts = _first_child(outline, "Nets"), _first_child(outline, "Components")
    both = nets.unionByName(parts).select("doc", "node").distinct()
    inside, level = both, both
    for _ in range(3):  # net, its list of pins, pin
        level = _children(outline, level).select("doc", "node")
        inside = inside.unionByName(level)
    sheets = outline.where("page >= 0").select("doc", F.col("node").alias("parent"), "page").join(inside.select("doc", F.col("node").alias("parent")).distinct(), ["doc", "parent"], "left_anti")
    on = lambda b: b.join(sheets, ["doc", "parent"]).select("doc", "node", F.col("parent").alias("sheet"), "page")
    return on(nets), on(parts)


def outline_nets(outline: DataFrame) -> DataFrame:
    """(doc, page, net, pins): pins of each net of a page as printed, in reading order; a net of several sheets of a page has the pins of all. Nets without pins are left out."""
    nets, _ = _branches(outline)
    named = _children(outline, nets, "page").select("doc", "node", F.col("title").alias("net"), "page")
    lists = _first_child(outline, "Pins").join(named.select("doc", F.col("node").alias("parent"), "net", "page"), ["doc", "parent"])
    pins = _children(outline, lists, "net", "page")
    return pins.groupBy("doc", "page", "net").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "title"))), lambda x: x["title"]).alias("pins"))


def outline_parts(outline: DataFrame) -> DataFrame:
    """(doc, page, ref, pins): the pin numbers of each part of a page, its name and one sign cut off, in reading order; of equal references the last counts. Drawings whose tree has no net with pins have no
    parts either."""
    _, comps = _branches(outline)
    last = Window.partitionBy("doc", "page", "title").orderBy(F.desc("node"))
    parts = _children(outline, comps, "page").withColumn("r", F.row_number().over(last)).where("r = 1").select("doc", "node", F.col("title").alias("ref"), "page")
    pins = _children(outline, parts.withColumn("own", F.col("node")), "own", "ref")
    no = F.transform(F.array_sort(F.collect_list(F.struct("node", F.substring("title", F.length("ref") + 2, F.length("title")).alias("no")))), lambda x: x["no"])
    pins = pins.groupBy("doc", F.col("own").alias("node")).agg(no.alias("pins"))
    out = parts.join(pins, NODE, "left").join(outline_nets(outline).select("doc").distinct(), "doc", "left_semi")
    return out.select("doc", "page", "ref", F.coalesce("pins", F.array().cast("array<string>")).alias("pins"))
