"""Outlines of parts: which texts lie in one, which outlines are flags around a label. Keyed by (doc, page); ``pages`` (doc, page, s, area) holds the text height and the area of a page, ``bodies`` are (doc, page, body,
x0, y0, x1, y1). Pages that are not listed, rows with null coordinates and empty tables give nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import KEY
from .spatial import grid_join, point_box, seg_box, text_box

BOX = ["x0", "y0", "x1", "y1"]
CELL = 40.0


def _big(pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``bodies`` with s, area, the page's area and whether they are larger than a label's outline: over 6 s² and 1.5 s at the shorter side."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    b = bodies.select(*KEY, "body", *BOX, (w * h).alias("size")).join(pages.select(*KEY, "s", "area"), KEY)
    big: Column = (F.col("size") > F.col("s") * F.col("s") * 6) & (F.least(w, h) > F.col("s") * 1.5)
    return b.withColumn("big", big)


def text_in_body(texts: DataFrame, bodies: DataFrame, segs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, text_id, body): the smallest part outline around the centre of each text, ties to the first. Outlines of labels do not count, nor do frames: those over a quarter of the page, and those
    with two wires or more wholly inside, max(0.3, 0.1 s) from the edges."""
    b = _big(pages, bodies).where("big")
    b = b.withColumn("m", F.greatest(F.lit(0.3), F.col("s") * 0.1))
    within = lambda w, b: (F.least(w["x1"], w["x2"]) > b["x0"] + b["m"]) & (F.greatest(w["x1"], w["x2"]) < b["x1"] - b["m"]) & (F.least(w["y1"], w["y2"]) > b["y0"] + b["m"]) & (F.greatest(w["y1"], w["y2"]) < b["y1"] - b["m"])
    box = b.select(*KEY, "body", "m", *BOX)
    wires = grid_join(segs.select(*KEY, "seg_id", "x1", "y1", "x2", "y2"), box, KEY, seg_box(), text_box(), CELL, within).groupBy("r.doc", "r.page", "r.body").agg(F.count("*").alias("n")).where("n >= 2")
    parts = b.where(F.col("size") <= F.col("area") * 0.25).join(wires.drop("n"), [*KEY, "body"], "left_anti").select(*KEY, "body", "size", *BOX)
    mid = texts.select(*KEY, "text_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    j = grid_join(mid, parts, KEY, point_box(), text_box(), CELL, lambda p, b: (p["x"] > b["x0"]) & (p["x"] < b["x1"]) & (p["y"] > b["y0"]) & (p["y"] < b["y1"]))
    best = j.select("l.doc", "l.page", "l.text_id", "r.size", "r.body").groupBy(*KEY, "text_id").agg(F.min(F.struct("size", "body")).alias("b"))
    return best.select(*KEY, "text_id", "b.body")


def flag_of_label(texts: DataFrame, bodies: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, text_id, body): outlines of a label's size around exactly one text, a net (doc, page, text_id, kind, x0, y0, x1, y1, size), 0.15 of whose size may stand out; of several the last."""
    b = _big(pages, bodies).where("not big").select(*KEY, "body", *BOX)
    m = F.col("size") * 0.15
    inner = (F.col("x0") + m, F.col("y0") + m, F.col("x1") - m, F.col("y1") - m)
    ordered = (F.least(inner[0], inner[2]), F.least(inner[1], inner[3]), F.greatest(inner[0], inner[2]), F.greatest(inner[1], inner[3]))
    holds = lambda t, b: (t["x0"] >= b["x0"] - t["size"] * 0.15) & (t["x1"] <= b["x1"] + t["size"] * 0.15) & (t["y0"] >= b["y0"] - t["size"] * 0.15) & (t["y1"] <= b["y1"] + t["size"] * 0.15)
    j = grid_join(texts.select(*KEY, "text_id", "kind", *BOX, "size"), b, KEY, ordered, text_box(), CELL, holds)
    one = j.select("l.doc", "l.page", "r.body", "l.text_id", "l.kind").groupBy(*KEY, "body").agg(F.count("*").alias("n"), F.min(F.struct("text_id", "kind")).alias("t")).where("n = 1 and t.kind = 'net'")
    return one.groupBy(*KEY, F.col("t.text_id").alias("text_id")).agg(F.max("body").alias("body"))
