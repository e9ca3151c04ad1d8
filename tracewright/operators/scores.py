"""Measures against the true wires of a drawing's source. Keyed by (doc, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import KEY
from .spatial import grid_join, point_box

CELL = 40.0


def fitted(truth: DataFrame, fits: DataFrame) -> DataFrame:
    """True wires (doc, page, x1, y1, x2, y2) laid on their drawing by its fit (doc, page, a, b, c, d, e, f); wires of pages without one are left out."""
    j = truth.select(*KEY, "x1", "y1", "x2", "y2").join(fits.select(*KEY, *"abcdef"), KEY)
    x = lambda n: F.col("a") * F.col(f"x{n}") + F.col("c") * F.col(f"y{n}") + F.col("e")
    y = lambda n: F.col("b") * F.col(f"x{n}") + F.col("d") * F.col(f"y{n}") + F.col("f")
    return j.select(*KEY, x(1).alias("x1"), y(1).alias("y1"), x(2).alias("x2"), y(2).alias("y2"))


def on_wires(segs: DataFrame, wires: DataFrame, off: float = 0.8) -> DataFrame:
    """(doc, page, seg_id) of the strokes on a true wire: both ends less than ``off`` beside its line, the middle between its ends or 5 % of its length beyond."""
    mid = segs.select(*KEY, "seg_id", "x1", "y1", "x2", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    length = lambda r: F.when((r["x1"] == r["x2"]) & (r["y1"] == r["y2"]), 1.0).otherwise(F.hypot(r["x2"] - r["x1"], r["y2"] - r["y1"]))

    def test(l, r):  # noqa: E741
        dx, dy, n = r["x2"] - r["x1"], r["y2"] - r["y1"], length(r)
        beside = lambda x, y: F.abs((x - r["x1"]) * dy - (y - r["y1"]) * dx) / n < off
        t = ((l["x"] - r["x1"]) * dx + (l["y"] - r["y1"]) * dy) / (n * n)
        return beside(l["x1"], l["y1"]) & beside(l["x2"], l["y2"]) & (t > -0.05) & (t < 1.05)

    c = F.col
    grow = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1"))) * 0.05 + off
    box = (F.least("x1", "x2") - grow, F.least("y1", "y2") - grow, F.greatest("x1", "x2") + grow, F.greatest("y1", "y2") + grow)
    j = grid_join(mid, wires.select(*KEY, "x1", "y1", "x2", "y2"), KEY, point_box(), box, CELL, test)
    return j.select("l.doc", "l.page", "l.seg_id").distinct()


def style_wire_stats(segs: DataFrame, truth: DataFrame, fits: DataFrame, most: int = 10) -> DataFrame:
    """(doc, page, rank, style, n, mean_len, closed, on_wire): of each fitted page the ``most`` styles with the greatest length, longest first, ties by name: strokes, their mean length, the share of them from
    closed figures and the share of their length that lies on true wires (null where a style has no length). ``segs``: doc, page, seg_id, x1, y1, x2, y2, style, closed; null closed counts as open."""
    wires = fitted(truth, fits)
    s = segs.select(*KEY, "seg_id", "style", "closed", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("len")).join(fits.select(*KEY), KEY, "left_semi")
    s = s.join(on_wires(segs, wires).withColumn("hit", F.lit(True)), [*KEY, "seg_id"], "left")
    g = s.groupBy(*KEY, "style").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.sum(F.coalesce(F.col("closed"), F.lit(False)).cast("long")).alias("shut"), F.sum(F.when(F.col("hit"), F.col("len")).otherwise(0.0)).alias("wire"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("len"), "style"))).where(F.col("rank") <= most)
    return g.select(*KEY, "rank", "style", "n", (F.col("len") / F.col("n")).alias("mean_len"), (F.col("shut") / F.col("n")).alias("closed"), F.try_divide("wire", "len").alias("on_wire"))


def net_scores(cells: DataFrame, truth: DataFrame, names: DataFrame, detected: DataFrame) -> DataFrame:
    """(doc, page, nets, exact, named, named_ok, wrong): true nets of three units or more, those one detected net covers to 95 % and hardly exceeds, those with names, those whose best match
    carries one of them in any case, and up to twelve wrong ones as true→detected, in the order of the true nets.

    ``cells`` (doc, page, net, gt_net, len): length that detected and true nets share; ``truth`` (doc, page, net, len): true wires; ``names`` (doc, page, gt_net, place, name); ``detected`` (doc, page, net, name). The best match
    shares most length, ties to the lower number; a net without one has the name "". Pages without true nets have no row.
    """
    real = truth.groupBy(*KEY, F.col("net").alias("gt_net")).agg(F.sum("len").alias("real")).where("real >= 3")
    best = cells.groupBy(*KEY, "gt_net").agg(F.max(F.struct("len", (-F.col("net")).alias("o"))).alias("b")).where("b.len > 0").select(*KEY, "gt_net", F.col("b.len").alias("len"), (-F.col("b.o")).alias("net"))
    total = cells.groupBy(*KEY, "net").agg(F.sum("len").alias("total"))
    called = names.where("name is not null").groupBy(*KEY, "gt_net").agg(F.collect_set(F.upper("name")).alias("upper"), F.min_by("name", "place").alias("first"))
    j = real.join(best, [*KEY, "gt_net"], "left").join(total, [*KEY, "net"], "left").join(detected.select(*KEY, "net", F.col("name").alias("got")), [*KEY, "net"], "left").join(called, [*KEY, "gt_net"], "left")
    exact = (F.col("len") / F.col("real") >= 0.95) & (F.col("len") / F.col("total") >= 0.95)
    got = F.coalesce("got", F.lit(""))
    ok = F.array_contains("upper", F.upper(got))
    wrong = F.when(F.col("first").isNotNull() & ~ok, F.struct("gt_net", F.concat("first", F.lit("→"), got).alias("w")))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = j.groupBy(*KEY).agg(F.count("*").alias("nets"), n(exact).alias("exact"), n(F.col("first").isNotNull()).alias("named"), n(ok).alias("named_ok"), F.slice(F.array_sort(F.collect_list(wrong)), 1, 12).alias("wrong"))
    return out.withColumn("wrong", F.array_join(F.transform("wrong", lambda w: w["w"]), ","))


def pin_scores(pins: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, page, pins, located, pin_precision, pin_recall, gt_nets, net_exact, naming, named_nets) of each page with pins of a netlist. ``pins`` (doc, page, pin, net, gt): net is the detected one, null
    where the pin was not found, which makes it a net of its own; ``names`` (doc, page, net, name).

    Precision and recall are of pairs of pins on one net (1 where there is none). Of true nets with two pins or more, net_exact is the share that one detected net holds alone and whole; naming is the share
    of those not called Net... whose commonest detected net, ties to the first pin, has their name in any case (null if there is none). Pins without a true net do not count.
    """
    p = pins.where("gt is not null").withColumn("own", F.when(F.col("net").isNull(), F.col("pin")))
    at = ["net", "own"]
    cell = p.groupBy(*KEY, *at, "gt").agg(F.count("*").alias("n"), F.min("pin").alias("first"))
    row = cell.groupBy(*KEY, *at).agg(F.sum("n").alias("row"))
    col = cell.groupBy(*KEY, "gt").agg(F.sum("n").alias("col"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    pairs = lambda df, c, name: df.groupBy(*KEY).agg(two(c).alias(name))
    # the commonest detected net of each true one
    top = cell.groupBy(*KEY, "gt").agg(F.min(F.struct((-F.col("n")).alias("o"), "first", "net")).alias("t")).select(*KEY, "gt", (-F.col("t.o")).alias("n"), F.col("t.net").alias("net"))
    top = top.join(col.where("col >= 2"), [*KEY, "gt"]).join(row.where("net is not null").drop("own"), [*KEY, "net"], "left").join(names.select(*KEY, "net", "name"), [*KEY, "net"], "left")
    real_name, ok = ~F.col("gt").startswith("Net"), F.coalesce(F.upper("name") == F.upper("gt"), F.lit(False))
    exact = F.coalesce((F.col("n") == F.col("col")) & (F.col("n") == F.col("row")), F.lit(False))
    nets = top.groupBy(*KEY).agg(F.count("*").alias("gt_nets"), F.avg(exact.cast("double")).alias("net_exact"), F.avg(F.when(real_name, ok.cast("double"))).alias("naming"), F.sum(real_name.cast("long")).alias("named_nets"))
    out = p.groupBy(*KEY).agg(F.count("*").alias("pins"), F.count("net").alias("located")).join(pairs(cell, "n", "tp"), KEY).join(pairs(row, "row", "pp"), KEY).join(pairs(col, "col", "ap"), KEY).join(nets, KEY, "left")
    share = lambda a: F.when(F.col(a) > 0, F.col("tp") / F.col(a)).otherwise(1.0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*KEY, "pins", "located", share("pp").alias("pin_precision"), share("ap").alias("pin_recall"), zero("gt_nets").alias("gt_nets"), F.coalesce("net_exact", F.lit(0.0)).alias("net_exact"), "naming", zero("named_nets").alias("named_nets"))
