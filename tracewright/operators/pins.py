"""Pins of a CAD netlist on the wires of a page. Keyed by (doc, page); rows with null coordinates meet nothing, pages without a height (``heights``: doc, page, s) and empty tables give nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import KEY
from .spatial import EPS, grid_join, seg_box, text_box

BOX = ["x0", "y0", "x1", "y1"]
SEG = ["x1", "y1", "x2", "y2"]
CELL = 20.0


def pin_segments(pins: DataFrame, segs: DataFrame, netlist: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc, page, pin_id, seg_id, own), stand-ins): the segment of each pin (doc, page, pin_id, name, x0, y0, x1, y1), and the segments (doc, page, seg_id, x1, y1, x2, y2) that pins stand in for.

    A pin's wire ends in its box, grown by 0.3 s, 1 at least: the end nearest to the centre, ties to the lower segment. Else a wire passes within EPS of the box. A pin of the netlist (doc, page, name, net) whose
    grown box no wire touches is wired straight onto another pin: its own long axis stands in (own), with an id after the page's last segment, counted in the order of pin_id. Other pins have none.
    """
    g = F.greatest(F.lit(1.0), F.col("s") * 0.3)
    listed = netlist.select(*KEY, "name", F.lit(True).alias("listed")).distinct()
    p = pins.dropna(subset=BOX).select(*KEY, "pin_id", "name", *BOX).join(heights.select(*KEY, g.alias("g")), KEY).join(listed, [*KEY, "name"], "left")
    grown = lambda b: (b["x0"] - b["g"], b["y0"] - b["g"], b["x1"] + b["g"], b["y1"] + b["g"])
    j = grid_join(p.select(*KEY, "pin_id", "g", *BOX), segs.select(*KEY, "seg_id", *SEG), KEY, text_box(F.col("g")), seg_box(), CELL, lambda b, w: G.dist_box_seg(grown(b), *[w[c] for c in SEG]) <= 0)
    b, w = F.col("l"), F.col("r")
    x0, y0, x1, y1 = grown(b)
    mx, my = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    end = lambda n: F.when((w[f"x{n}"] >= x0) & (w[f"x{n}"] <= x1) & (w[f"y{n}"] >= y0) & (w[f"y{n}"] <= y1), F.hypot(w[f"x{n}"] - mx, w[f"y{n}"] - my))
    j = j.select("l.doc", "l.page", "l.pin_id", "r.seg_id", F.least(end(1), end(2)).alias("end"), G.dist_box_seg(tuple(b[c] for c in BOX), *[w[c] for c in SEG]).alias("by"))
    first = lambda d, keep: F.min(F.when(keep, F.struct(F.col(d).alias("d"), "seg_id")))["seg_id"]
    met = j.groupBy(*KEY, "pin_id").agg(F.coalesce(first("end", F.col("end").isNotNull()), first("by", F.col("by") <= EPS)).alias("seg_id"))
    free = p.where("listed").join(met, [*KEY, "pin_id"], "left_anti")
    last = segs.groupBy(*KEY).agg(F.max("seg_id").alias("last"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("pin_id"))
    free = free.join(last, KEY, "left").withColumn("seg_id", F.coalesce("last", F.lit(-1)) + number)
    c = F.col
    wide, cx, cy = c("x1") - c("x0") >= c("y1") - c("y0"), (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    pick = lambda u, v: F.when(wide, u).otherwise(v)
    stand = free.select(*KEY, "seg_id", pick(c("x0"), cx).alias("x1"), pick(cy, c("y0")).alias("y1"), pick(c("x1"), cx).alias("x2"), pick(cy, c("y1")).alias("y2"))
    own = free.select(*KEY, "pin_id", "seg_id", F.lit(True).alias("own"))
    return met.where("seg_id is not null").select(*KEY, "pin_id", "seg_id", F.lit(False).alias("own")).unionByName(own), stand


def netlist_edges(located: DataFrame, pins: DataFrame, netlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, names): star edges (doc, page, src, dst) from the segment of a net's first pin to those of its others, which is how stand-ins join, and the names (doc, page, seg_id, name) that the netlist gives to segments,
    without those that are only numbered (Net...); of several names of a segment the last pin's counts."""
    n = located.join(pins.select(*KEY, "pin_id", "name"), [*KEY, "pin_id"]).join(netlist.select(*KEY, "name", "net").distinct(), [*KEY, "name"])
    first = n.groupBy(*KEY, "net").agg(F.min_by("seg_id", "pin_id").alias("src"))
    edges = n.join(first, [*KEY, "net"]).where("src <> seg_id").select(*KEY, F.least("src", "seg_id").alias("src"), F.greatest("src", "seg_id").alias("dst")).distinct()
    names = n.where(~F.col("net").startswith("Net")).groupBy(*KEY, "seg_id").agg(F.max_by("net", "pin_id").alias("name"))
    return edges, names
