"""Symbols of parts: strokes that touch become one symbol, texts find theirs, wires are cut at diodes, islands without a name go. Keyed by (doc, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graph import KEY, connected_components
from .spatial import dist_point_seg, grid_join, point_box, seg_box, text_box

BOX = ["x0", "y0", "x1", "y1"]
CELL = 20.0


def _box(r):
    return tuple(r[c] for c in BOX)


def glue_symbols(boxes: DataFrame, margin: float) -> DataFrame:
    """(doc, page, box_id, symbol): boxes within ``margin`` of one another on both axes are one symbol, named by its first box; chains count."""
    b = boxes.select(*KEY, F.col("box_id").alias("seg_id"), *BOX)
    meet = lambda l, r: (l["seg_id"] < r["seg_id"]) & (r["x0"] <= l["x1"] + margin) & (r["x1"] >= l["x0"] - margin) & (r["y0"] <= l["y1"] + margin) & (r["y1"] >= l["y0"] - margin)  # noqa: E731, E741
    edges = grid_join(b, b, KEY, text_box(margin), text_box(), CELL, meet).select("l.doc", "l.page", F.col("l.seg_id").alias("src"), F.col("r.seg_id").alias("dst"))
    return connected_components(b, edges).select(*KEY, F.col("seg_id").alias("box_id"), F.col("root").alias("symbol"))


def symbol_boxes(boxes: DataFrame, glued: DataFrame, largest: float) -> DataFrame:
    """(doc, page, symbol, x0 ..): the union box of each symbol whose longer side is under ``largest``."""
    u = boxes.join(glued, [*KEY, "box_id"]).groupBy(*KEY, "symbol").agg(*[(F.min if c in ("x0", "y0") else F.max)(c).alias(c) for c in BOX])
    return u.where(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < largest)


def home_symbol(texts: DataFrame, boxes: DataFrame, glued: DataFrame, reach: float) -> DataFrame:
    """(doc, page, text_id, symbol): the symbol of the box nearest to each text, closer than ``reach``; of equally near boxes the first."""
    t = texts.where("kind not in ('pin', 'note')").select(*KEY, "text_id", *BOX)
    gap = lambda a, b: G.box_gap(_box(a), _box(b))
    j = grid_join(t, boxes.select(*KEY, "box_id", *BOX), KEY, text_box(reach), text_box(), CELL, lambda a, b: gap(a, b) < reach)
    best = j.select("l.doc", "l.page", "l.text_id", gap(F.col("l"), F.col("r")).alias("d"), "r.box_id").groupBy(*KEY, "text_id").agg(F.min(F.struct("d", "box_id")).alias("b"))
    return best.select(*KEY, "text_id", "b.box_id").join(glued, [*KEY, "box_id"]).select(*KEY, "text_id", "symbol")


def symbol_between(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (doc, page, a, b, ax0 .. ay1, bx0 .. by1: two text boxes) with a box in the strip between the two."""
    c = F.col
    wide = F.greatest("ax0", "bx0") > F.least("ax1", "bx1")
    strip = {
        "x0": F.when(wide, F.least("ax1", "bx1")).otherwise(F.greatest("ax0", "bx0")), "x1": F.when(wide, F.greatest("ax0", "bx0")).otherwise(F.least("ax1", "bx1")),
        "y0": F.when(wide, F.greatest("ay0", "by0")).otherwise(F.least("ay1", "by1")), "y1": F.when(wide, F.least("ay1", "by1")).otherwise(F.greatest("ay0", "by0")),
    }
    s = pairs.select(*KEY, "a", "b", *[v.alias(k) for k, v in strip.items()]).where((c("x1") > c("x0")) & (c("y1") > c("y0")))
    meet = lambda p, b: (b["x0"] < p["x1"]) & (b["x1"] > p["x0"]) & (b["y0"] < p["y1"]) & (b["y1"] > p["y0"])
    return grid_join(s, boxes.select(*KEY, *BOX), KEY, text_box(), text_box(), CELL, meet).select("l.doc", "l.page", "l.a", "l.b").distinct()


def cut_at_triangles(segs: DataFrame, triangles: DataFrame, margin: float = 0.05) -> DataFrame:
    """(doc, page, seg_id, piece, x1, y1, x2, y2): level and upright segments without the stretches on which they pierce a triangle box (x0, y0, x1, y1) from side to side. All
    stretches of a segment are merged first, so overlapping triangles cut once; pieces are numbered along the segment. Uncut segments have piece 0."""
    s = segs.select(*KEY, "seg_id", "x1", "y1", "x2", "y2")

    def lies(r):
        level = F.abs(r["y1"] - r["y2"]) < 0.02
        return level, F.when(level, r["y1"]).otherwise(r["x1"]), F.when(level, F.least(r["x1"], r["x2"])).otherwise(F.least(r["y1"], r["y2"])), F.when(level, F.greatest(r["x1"], r["x2"])).otherwise(F.greatest(r["y1"], r["y2"]))

    def spans(r, b):
        level = lies(r)[0]
        return F.when(level, b["y0"]).otherwise(b["x0"]), F.when(level, b["y1"]).otherwise(b["x1"]), F.when(level, b["x0"]).otherwise(b["y0"]), F.when(level, b["x1"]).otherwise(b["y1"])

    def pierces(r, b):
        _, across, lo, hi = lies(r)
        c0, c1, a0, a1 = spans(r, b)
        return (across > c0 + margin) & (across < c1 - margin) & (lo < a0 - margin) & (hi > a1 + margin)

    j = grid_join(s, triangles.select(*KEY, *BOX), KEY, seg_box(), text_box(), CELL, pierces)
    a0, a1 = spans(F.col("l"), F.col("r"))[2:]
    w = Window.partitionBy(*KEY, "seg_id").orderBy("a", "z")
    cuts = j.select("l.doc", "l.page", "l.seg_id", a0.alias("a"), a1.alias("z"))
    cuts = cuts.withColumn("open", (F.col("a") > F.coalesce(F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))).cast("int"))
    cuts = cuts.withColumn("k", F.sum("open").over(w)).groupBy(*KEY, "seg_id", "k").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    cuts = cuts.groupBy(*KEY, "seg_id").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("cuts"))
    level, across, lo, hi = lies({n: F.col(n) for n in ("x1", "y1", "x2", "y2")})
    x = s.join(cuts, [*KEY, "seg_id"]).withColumns({"level": level, "across": across})
    starts = F.concat(F.array(lo), F.transform("cuts", lambda c: c["z"]))
    stops = F.concat(F.transform("cuts", lambda c: c["a"]), F.array(hi))
    x = x.select(*KEY, "seg_id", "level", "across", F.posexplode(F.arrays_zip(starts.alias("a"), stops.alias("z"))).alias("piece", "p"))
    at = lambda e, along: F.when(F.col("level") == along, F.col(f"p.{e}")).otherwise(F.col("across"))
    x = x.select(*KEY, "seg_id", "piece", at("a", True).alias("x1"), at("a", False).alias("y1"), at("z", True).alias("x2"), at("z", False).alias("y2"))
    return x.unionByName(s.join(cuts, [*KEY, "seg_id"], "left_anti").withColumn("piece", F.lit(0)).select(x.columns))


def prune_islands(wires: DataFrame, dots: DataFrame, named: DataFrame, largest: float, eps: float = 0.15) -> DataFrame:
    """``wires`` (doc, page, seg_id, net_id, x1 ..) without nets that are smaller than ``largest``, have no name, pin or ground (``named``: doc, page, net_id) and
    no dot; the nets left are counted anew in the order of their first segment."""
    size = wires.groupBy(*KEY, "net_id").agg(F.min("seg_id").alias("first"), *[f(F.greatest(f"{a}1", f"{a}2") if f is F.max else F.least(f"{a}1", f"{a}2")).alias(f"{a}{n}") for a in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    big = size.where(F.greatest(F.col("xhi") - F.col("xlo"), F.col("yhi") - F.col("ylo")) >= largest).select(*KEY, "net_id")
    on = lambda d, s: dist_point_seg(d["x"], d["y"], s["x1"], s["y1"], s["x2"], s["y2"]) <= F.greatest(d["r"], F.lit(eps))
    dotted = grid_join(dots.select(*KEY, "x", "y", "r"), wires.select(*KEY, "net_id", "x1", "y1", "x2", "y2"), KEY, point_box(grow=F.greatest(F.col("r"), F.lit(eps))), seg_box(), CELL, on).select("l.doc", "l.page", "r.net_id")
    keep = big.unionByName(dotted).unionByName(named.select(*KEY, "net_id")).distinct()
    ids = size.join(keep, [*KEY, "net_id"]).withColumn("new_id", (F.row_number().over(Window.partitionBy(*KEY).orderBy("first")) - 1).cast("long"))
    return wires.join(ids.select(*KEY, "net_id", "new_id"), [*KEY, "net_id"]).drop("net_id").withColumnRenamed("new_id", "net_id")
