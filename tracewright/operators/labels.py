"""Which wire a label names, which texts belong to pins, parts and links. All tables are keyed by (doc, page); rows with null coordinates meet nothing, empty
tables give empty results, further columns are not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text_rules import LOOSE_REF, is_bare_voltage, is_power_name
from .graph import KEY
from .spatial import beside, grid_join, label_along_wire, point_box, seg_box, text_box

SEG = [*KEY, "seg_id", "x1", "y1", "x2", "y2"]
BOX = ["x0", "y0", "x1", "y1"]
CELL = 20.0


def _box(r):
    return tuple(r[c] for c in BOX)


def _inside(x, y, b, m=0.0):
    return (x >= b["x0"] - m) & (x <= b["x1"] + m) & (y >= b["y0"] - m) & (y <= b["y1"] + m)


def _mid(t):
    return (t["x0"] + t["x1"]) / 2, (t["y0"] + t["y1"]) / 2


def nearest_segment(boxes: DataFrame, segs: DataFrame, id_col: str, reach: float) -> DataFrame:
    """(doc, page, id, seg_id, d): the segment nearest to each box (x0, y0, x1, y1) within ``reach``; of equally near ones the first."""
    b = boxes.select(*KEY, id_col, *BOX)
    d = lambda t, w: G.dist_box_seg(_box(t), w["x1"], w["y1"], w["x2"], w["y2"])
    j = grid_join(b, segs.select(SEG), KEY, text_box(reach), seg_box(), CELL, lambda t, w: d(t, w) <= reach)
    best = j.select("l.doc", "l.page", f"l.{id_col}", d(F.col("l"), F.col("r")).alias("d"), "r.seg_id").groupBy(*KEY, id_col).agg(F.min(F.struct("d", "seg_id")).alias("b"))
    return best.select(*KEY, id_col, "b.seg_id", "b.d")


def pin_under_text(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, text_id, cover): the largest share of a text's length that one parallel pin line runs under; texts over no line are left out."""

    def test(t, w):
        cos, off, lo, hi, length = beside(t, w)
        return (cos >= 0.97) & (off >= t["size"] * -0.7) & (off <= t["size"] * 0.3) & (F.least(hi, length) > F.greatest(lo, F.lit(0.0)))

    j = grid_join(texts.select(*KEY, "text_id", *BOX, "ax", "ay", "size", "rot"), lines.select(SEG), KEY, text_box(5.0), seg_box(), CELL, test)
    _, _, lo, hi, length = beside(F.col("l"), F.col("r"))
    return j.select("l.doc", "l.page", "l.text_id", ((F.least(hi, length) - F.greatest(lo, F.lit(0.0))) / length).alias("c")).groupBy(*KEY, "text_id").agg(F.round(F.max("c"), 6).alias("cover"))


def pin_end_in_line(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, text_id): texts at which a level or upright pin line ends, within 1.1 of their size, pointing at the middle band of the lettering."""

    def test(t, w):
        level, s = t["rot"] == 0, t["size"]
        pick = lambda a, b: F.when(level, a).otherwise(b)
        flat = F.abs(pick(w["y1"] - w["y2"], w["x1"] - w["x2"])) <= 0.02
        across = pick(w["y1"], w["x1"])
        band = (across >= pick(t["y0"], t["x0"]) + s * 0.15) & (across <= pick(t["y1"], t["x1"]) - s * 0.15)
        a0, a1 = pick(t["x0"], t["y0"]), pick(t["x1"], t["y1"])
        p0, p1 = F.least(pick(w["x1"], w["y1"]), pick(w["x2"], w["y2"])), F.greatest(pick(w["x1"], w["y1"]), pick(w["x2"], w["y2"]))
        gap = F.when(p1 <= a0 + s * 0.2, a0 - p1).when(p0 >= a1 - s * 0.2, p0 - a1)
        return flat & band & (gap <= s * 1.1)

    j = grid_join(texts.select(*KEY, "text_id", *BOX, "size", "rot"), lines.select(SEG), KEY, text_box(10.0), seg_box(), CELL, test)
    return j.select("l.doc", "l.page", "l.text_id").distinct()


def glyph_under(strokes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, prim_id, text_id): the first text whose box, grown by 0.45 of its size, holds a stroke of at most 1.6 of that size."""

    def test(p, t):
        s, m = t["size"], t["size"] * 0.45
        small = F.greatest(p["x1"] - p["x0"], p["y1"] - p["y0"]) <= s * 1.6
        return small & (p["x0"] >= t["x0"] - m) & (p["x1"] <= t["x1"] + m) & (p["y0"] >= t["y0"] - m) & (p["y1"] <= t["y1"] + m)

    mid = ((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2) * 2
    j = grid_join(strokes.select(*KEY, "prim_id", *BOX), texts.select(*KEY, "text_id", *BOX, "size"), KEY, mid, tuple(F.col(c) + F.col("size") * (1 if k > 1 else -1) for k, c in enumerate(BOX)), CELL, test)
    return j.groupBy("l.doc", "l.page", "l.prim_id").agg(F.min("r.text_id").alias("text_id"))


def pen_of_text(strokes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, text_id, color): the colour of the strokes well inside a text (0.12 of its size) where it leads the next one at least twofold."""
    under = glyph_under(strokes, texts)
    j = under.join(strokes.select(*KEY, "prim_id", *BOX, "color"), [*KEY, "prim_id"]).alias("p").join(texts.select(*KEY, "text_id", "size", *[F.col(c).alias(f"t{c}") for c in BOX]), [*KEY, "text_id"])
    m = F.col("size") * 0.12
    j = j.where((F.col("x0") >= F.col("tx0") - m) & (F.col("x1") <= F.col("tx1") + m) & (F.col("y0") >= F.col("ty0") - m) & (F.col("y1") <= F.col("ty1") + m))
    w = Window.partitionBy(*KEY, "text_id").orderBy(F.desc("n"), "color")
    n = j.groupBy(*KEY, "text_id", "color").agg(F.count("*").alias("n")).withColumns({"r": F.row_number().over(w), "next": F.lead("n").over(w)})
    return n.where((F.col("r") == 1) & (F.col("next").isNull() | (F.col("n") >= F.col("next") * 2))).select(*KEY, "text_id", "color")


def symbol_candidates(texts: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(doc, page, text_id, sym_id, gap, r): up to ``most`` nearest symbols within 1.6 of a text's size that overlap it on an axis by half of the smaller extent (0.35 for supply
    names) and do not hold the centre of another text; ties go to the lower sym_id. A port outline (port, where symbols have that column) must have the text within 0.7 of its size
    in line with it, and how far the text lies off its axis counts as further distance: of stacked ports the one in line wins."""
    t, s = texts.select(*KEY, "text_id", "str", *BOX, "size"), symbols.select(*KEY, "sym_id", *BOX, (F.coalesce("port", F.lit(False)) if "port" in symbols.columns else F.lit(False)).alias("port"))
    gap = lambda a, b: G.box_gap(_box(a), _box(b))
    level = lambda b: b["x1"] - b["x0"] >= b["y1"] - b["y0"]

    def in_line(a, b):
        (tx, ty), m = _mid(a), a["size"] * 0.7
        return ~b["port"] | F.when(level(b), (ty >= b["y0"] - m) & (ty <= b["y1"] + m)).otherwise((tx >= b["x0"] - m) & (tx <= b["x1"] + m))

    def across(a, b):
        (tx, ty), (bx, by) = _mid(a), _mid(b)
        return F.when(~b["port"], 0.0).otherwise(F.when(level(b), F.abs(ty - by)).otherwise(F.abs(tx - bx)))

    def share(a, b, lo, hi):
        return F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])) / F.greatest(F.lit(1e-6), F.least(a[hi] - a[lo], b[hi] - b[lo]))

    def test(a, b):
        need = F.when(is_power_name(a["str"]), 0.35).otherwise(0.5)
        return (gap(a, b) <= a["size"] * 1.6) & in_line(a, b) & ((share(a, b, "x0", "x1") >= need) | (share(a, b, "y0", "y1") >= need))

    reach = tuple(F.col(c) + F.col("size") * (1.6 if k > 1 else -1.6) for k, c in enumerate(BOX))
    near = grid_join(t, s, KEY, reach, text_box(), CELL, test).select("l.doc", "l.page", "l.text_id", "r.sym_id", gap(F.col("l"), F.col("r")).alias("gap"), across(F.col("l"), F.col("r")).alias("across"))
    at = t.select(*KEY, F.col("text_id").alias("other"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    wraps = grid_join(at, s, KEY, point_box(), text_box(), CELL, lambda p, b: (p["x"] > b["x0"]) & (p["x"] < b["x1"]) & (p["y"] > b["y0"]) & (p["y"] < b["y1"]))
    wraps = wraps.select("l.doc", "l.page", "l.other", "r.sym_id").alias("w")
    n = near.alias("n")
    same = [F.col(f"n.{c}") == F.col(f"w.{c}") for c in (*KEY, "sym_id")]
    free = n.join(wraps, same[0] & same[1] & same[2] & (F.col("n.text_id") != F.col("w.other")), "left_anti")
    order = Window.partitionBy(*KEY, "text_id").orderBy(F.col("gap") + F.col("across"), "sym_id")
    return free.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(*KEY, "text_id", "sym_id", F.round("gap", 6).alias("gap"), "r")


def _ends_at_box(boxes: DataFrame, segs: DataFrame, id_col: str, margin: float) -> DataFrame:
    """(doc, page, id, seg_id, x, y, upright, mx, my): wires with one end (x, y) in a box, grown by ``margin`` (by its own, where boxes have a column margin), and the other outside; (mx, my) is the centre."""
    b, s = boxes.select(*KEY, id_col, *BOX, F.greatest(F.lit(margin), F.col("margin")).alias("m") if "margin" in boxes.columns else F.lit(margin).alias("m")), segs.select(SEG)
    in_ = lambda b, w, e: _inside(w[f"x{e}"], w[f"y{e}"], b, b["m"])
    j = grid_join(b, s, KEY, text_box(F.col("m")), seg_box(), CELL, lambda b, w: in_(b, w, 1) != in_(b, w, 2))
    box, w = F.col("l"), F.col("r")
    first = in_(box, w, 1)
    mx, my = _mid(box)
    at = lambda c: F.when(first, w[f"{c}1"]).otherwise(w[f"{c}2"]).alias(c)
    return j.select("l.doc", "l.page", f"l.{id_col}", "r.seg_id", at("x"), at("y"), (F.abs(w["x1"] - w["x2"]) < 0.02).alias("upright"), mx.alias("mx"), my.alias("my"))


def wire_end_at_box(boxes: DataFrame, segs: DataFrame, id_col: str, margin: float = 0.0) -> DataFrame:
    """(doc, page, id, seg_id, d): of the wires with one end in the box, grown by ``margin`` (by its own, where boxes have a column margin), and the other outside, the one whose end
    lies nearest to its centre."""
    d = F.round(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 6)
    best = _ends_at_box(boxes, segs, id_col, margin).groupBy(*KEY, id_col).agg(F.min(F.struct(d.alias("d"), "seg_id")).alias("b"))
    return best.select(*KEY, id_col, "b.seg_id", "b.d")


def wire_end_for_label(cand: DataFrame, symbols: DataFrame, segs: DataFrame, texts: DataFrame, margin: float, axis: bool) -> DataFrame:
    """(doc, page, text_id, sym_id, r, seg_id): for each candidate (doc, page, text_id, sym_id, r) the wire that ends at its symbol: nearest to the symbol's centre, to the label's own where a link names it (linked); with
    ``axis`` one that the label stands in line with, within 0.3 of its size, comes before all others: two supply arrows that touch are one symbol, but each name goes with its own wire. Ties: the first wire."""
    linked = F.coalesce("linked", F.lit(False)) if "linked" in texts.columns else F.lit(False)
    t = texts.select(*KEY, "text_id", F.struct(*BOX).alias("t"), "size", linked.alias("linked"))
    j = cand.select(*KEY, "text_id", "sym_id", "r").join(_ends_at_box(symbols, segs, "sym_id", margin), [*KEY, "sym_id"]).join(t, [*KEY, "text_id"])
    c = F.col
    tx, ty = _mid(c("t"))
    pick = lambda a, b: F.when(c("linked"), a).otherwise(b)
    d = F.round(F.hypot(c("x") - pick(tx, c("mx")), c("y") - pick(ty, c("my"))), 6)
    m = c("size") * 0.3
    off = F.when(c("upright"), (c("x") < c("t.x0") - m) | (c("x") > c("t.x1") + m)).otherwise((c("y") < c("t.y0") - m) | (c("y") > c("t.y1") + m))
    best = j.groupBy(*KEY, "text_id", "sym_id", "r").agg(F.min(F.struct((off if axis else F.lit(False)).alias("off"), d.alias("d"), "seg_id")).alias("b"))
    return best.select(*KEY, "text_id", "sym_id", "r", "b.seg_id")


def attach_labels(texts: DataFrame, segs: DataFrame, symbols: DataFrame, flags: DataFrame, touch: float = 0.6, monochrome: bool = True) -> DataFrame:
    """(doc, page, text_id, seg_id, via, port): the wire that each net text outside bodies names, by the first rule that finds one: along the wire; a flag outline
    around the text (``flags``: doc, page, text_id, x0 ..) that touches a wire; one of the three nearest symbols between text and wire end, the wire leaving on the
    far side; a supply name in a field pen over the stub of its symbol; in monochrome drawings a wire right at the text. Bare voltages need a symbol or a flag. Each rule is a table of its own; a rank picks.

    Where texts have a ``role`` (that of their pen, see ``pens.pen_roles``), those of a field pen are not taken along a wire or by a flag, and by a symbol only if they are supply names or stand on the axis of its
    wire; those of a pin pen only by a flag. Symbols may have ``port`` (an outline of loose strokes: ``outlines.port_outlines``) and ``margin`` (how far a wire may stop short of them).
    """
    t = texts.where("kind = 'net'")
    if "in_body" in t.columns:
        t = t.where(~F.coalesce("in_body", F.lit(False)))
    role = F.coalesce("role", F.lit("")) if "role" in t.columns else F.lit("")
    t = t.withColumn("role", role)
    plain = t.where(~is_bare_voltage(F.col("str")))
    named = plain.where("role not in ('field', 'pin')")
    found = lambda df, rule, via, port: df.select(*KEY, "text_id", "seg_id", F.lit(rule).alias("rule"), F.lit(via).alias("via"), F.lit(port).alias("port"))
    along = found(label_along_wire(named, segs), 1, "along", True)
    flag = found(nearest_segment(flags.join(t.where("role <> 'field'").select(*KEY, "text_id"), [*KEY, "text_id"], "left_semi"), segs, "text_id", touch), 2, "flag", True)
    # texts of pin pens take no symbol, but a symbol that holds one is still theirs
    cand = wire_end_for_label(symbol_candidates(t, symbols), symbols, segs, t, touch, not monochrome)
    cand = cand.join(segs.select(SEG), [*KEY, "seg_id"]).join(t.where("role <> 'pin'").select(*KEY, "text_id", "str", "size", "role", F.struct(BOX).alias("t")), [*KEY, "text_id"]).join(symbols.select(*KEY, "sym_id", F.struct(BOX).alias("b")), [*KEY, "sym_id"])
    tx, ty = _mid(F.col("t"))
    sx, sy = _mid(F.col("b"))
    one, two = F.hypot(F.col("x1") - tx, F.col("y1") - ty), F.hypot(F.col("x2") - tx, F.col("y2") - ty)
    wx, wy, s = F.when(one <= two, F.col("x1")).otherwise(F.col("x2")), F.when(one <= two, F.col("y1")).otherwise(F.col("y2")), F.col("size")
    beside_axis = F.abs(wx - tx) <= s * 0.6 + (F.col("t.x1") - F.col("t.x0")) * 0.1
    on_axis = F.when(F.abs(F.col("x1") - F.col("x2")) < 0.02, beside_axis).otherwise((wy >= F.col("t.y0") - s * 0.5) & (wy <= F.col("t.y1") + s * 0.5))
    fits = (F.col("role") != "field") | is_power_name(F.col("str")) | on_axis
    best = cand.where((F.least(one, two) + 0.1 >= F.hypot(sx - tx, sy - ty)) & fits).groupBy(*KEY, "text_id").agg(F.min_by("seg_id", "r").alias("seg_id"))
    rules = along.unionByName(flag).unionByName(found(best, 3, "symbol", True))
    if "role" in texts.columns:
        rules = rules.unionByName(found(label_along_wire(plain.where((F.col("role") == "field") & is_power_name(F.col("str"))), segs), 4, "along", True))
    if monochrome:
        reach = F.greatest(F.lit(0.6), F.col("size") * 0.4)
        last = plain.where((F.col("role") != "pin") & ~((F.col("role") == "field") & is_power_name(F.col("str"))))
        near = nearest_segment(last, segs, "text_id", 16.0).join(last.select(*KEY, "text_id", "size"), [*KEY, "text_id"]).where(F.col("d") <= reach)
        rules = rules.unionByName(found(near, 5, "near", False))
    first = rules.groupBy(*KEY, "text_id").agg(F.min(F.struct("rule", "seg_id", "via", "port")).alias("f"))
    return first.select(*KEY, "text_id", "f.seg_id", "f.via", "f.port")


def link_best_text(links: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, page, link_id, text_id): the text that a link box wraps: its centre within 0.3 of its size, most area in common, the first of equal ones."""
    common = lambda t, b: F.greatest(F.lit(0.0), F.least(t["x1"], b["x1"]) - F.greatest(t["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(t["y1"], b["y1"]) - F.greatest(t["y0"], b["y0"]))
    j = grid_join(links.select(*KEY, "link_id", *BOX), texts.select(*KEY, "text_id", *BOX, "size"), KEY, text_box(), text_box(), CELL, lambda b, t: _inside(*_mid(t), b, t["size"] * 0.3) & (common(t, b) > 0))
    best = j.select("l.doc", "l.page", "l.link_id", (-common(F.col("r"), F.col("l"))).alias("a"), "r.text_id").groupBy(*KEY, "link_id").agg(F.min(F.struct("a", "text_id")).alias("b"))
    return best.select(*KEY, "link_id", "b.text_id")


def wire_in_link_filter(segs: DataFrame, links: DataFrame) -> DataFrame:
    """``segs`` without those of which both ends lie inside link boxes, one or two: there they are lettering."""
    at = F.explode(F.array(F.struct(F.lit(1).alias("e"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(2).alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y"))))
    ends = segs.select(*KEY, "seg_id", at.alias("p")).select(*KEY, "seg_id", "p.*")
    held = grid_join(ends, links.select(*KEY, *BOX), KEY, point_box(), text_box(), CELL, lambda p, b: (p["x"] > b["x0"]) & (p["x"] < b["x1"]) & (p["y"] > b["y0"]) & (p["y"] < b["y1"]))
    both = held.groupBy("l.doc", "l.page", "l.seg_id").agg(F.count_distinct("l.e").alias("n")).where("n = 2")
    return segs.join(both, [*KEY, "seg_id"], "left_anti")


def marker_refs(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``texts`` with kind set by the exact references of a page (doc, page, ref): those are parts, look-alikes outside bodies are nets where they name one
    (net_id) and notes elsewhere. Pages without any reference stay."""
    r = refs.select(*KEY, F.col("ref").alias("str"), F.lit(True).alias("__exact")).distinct()
    page = refs.select(*KEY, F.lit(True).alias("__any")).distinct()
    j = texts.join(page, KEY, "left").join(r, [*KEY, "str"], "left")
    body = F.coalesce("in_body", F.lit(False)) if "in_body" in texts.columns else F.lit(False)
    alike = F.col("__any") & (F.col("kind") == "component") & F.col("str").rlike(r"^[A-Z]+\d+$") & ~body
    kind = F.when(F.col("__exact"), "component").when(alike, F.when(F.col("net_id").isNotNull(), "net").otherwise("note")).otherwise(F.col("kind"))
    return j.withColumn("kind", kind).select(texts.columns)


def loose_refs(texts: DataFrame) -> DataFrame:
    """(doc, page, text_id): net texts that name no wire (net_id null), look like references and have a value of similar size within 3 by 2.5 sizes."""
    t = texts.select(*KEY, "text_id", "str", "kind", *BOX, "size", "net_id")
    loose = t.where((F.col("kind") == "net") & F.col("net_id").isNull() & F.col("str").rlike(LOOSE_REF) & ~is_power_name(F.col("str")))
    reach = (F.col("x0") - F.col("size") * 3, F.col("y0") - F.col("size") * 2.5, F.col("x1") + F.col("size") * 3, F.col("y1") + F.col("size") * 2.5)

    def near(a, b):
        s = a["size"]
        meets = (b["x0"] <= a["x1"] + s * 3) & (b["x1"] >= a["x0"] - s * 3) & (b["y0"] <= a["y1"] + s * 2.5) & (b["y1"] >= a["y0"] - s * 2.5)
        return meets & (F.abs(a["size"] - b["size"]) < s * 0.35)

    return grid_join(loose, t.where("kind = 'value'"), KEY, reach, text_box(), CELL, near).select("l.doc", "l.page", "l.text_id").distinct()


def pin_like_refs(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, text_id): references that are names of pins: in a body at the end of a pin line, or over half covered by one and written twice or more on the page."""
    c = texts.where("kind = 'component'")
    times = c.groupBy(*KEY, "str").agg(F.count("*").alias("times"))
    on = pin_under_text(c, lines).where("cover > 0.5").select(*KEY, "text_id").join(c.select(*KEY, "text_id", "str"), [*KEY, "text_id"]).join(times.where("times >= 2"), [*KEY, "str"])
    at = pin_end_in_line(c.where("in_body"), lines)
    return on.select(*KEY, "text_id").unionByName(at).distinct()


def ground_label_attach(texts: DataFrame, ground: DataFrame, reach: float) -> DataFrame:
    """(doc, page, text_id, seg_id): for each ground label of ``texts`` the nearest segment at a ground symbol (``ground``: segments) closer than ``reach``."""
    return nearest_segment(texts.where(F.col("str").rlike("(?i)GND|VSS|EARTH")), ground, "text_id", reach).where(F.col("d") < reach).select(*KEY, "text_id", "seg_id")
