"""Outlines that a drawing does not hold as closed paths: bodies of four lines, arrow-tipped ports of loose strokes.

Both are walks over strokes whose ends meet. Ends meet in grid joins keyed by (doc, page, cell); a walk is a chain of joins on the stroke and its other end, and each
joined table keeps only walks that can still close. Sizes are relative to ``s``, the text height of a page (``heights``: doc, page, s). Rows with null coordinates
meet nothing, pages without a height have no outlines, empty tables give empty results, further columns are not looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import KEY, dropped_repeats
from .spatial import grid_join, point_box, seg_box, text_box

LINE = ["x1", "y1", "x2", "y2"]
BOX = ["x0", "y0", "x1", "y1"]
CELL = 20.0


def _place(v: Column, tol: Column) -> Column:
    return F.floor(v / tol + 0.5)


def _ends(lines: DataFrame, id_col: str, *more: str) -> DataFrame:
    """One row for each end of each line: (doc, page, id, e, x, y, fx, fy), f the far end."""
    end = lambda e, n, f: F.struct(F.lit(e).alias("e"), F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y"), F.col(f"x{f}").alias("fx"), F.col(f"y{f}").alias("fy"))
    return lines.select(*KEY, id_col, *more, F.explode(F.array(end(0, 1, 2), end(1, 2, 1))).alias("p")).select(*KEY, id_col, *more, "p.*")


def _step(l, r, tol: Column, c: str) -> Column:  # noqa: E741
    """How many cells of width ``tol`` the end r lies beyond l on an axis."""
    return _place(r[c], tol) - _place(l[c], tol)


def _meet(l, r, tol: Column) -> Column:  # noqa: E741
    """Ends in neighbouring cells of width ``tol``, at most 1.5 of it apart."""
    return (F.abs(_step(l, r, tol, "x")) <= 1) & (F.abs(_step(l, r, tol, "y")) <= 1) & (F.hypot(l["x"] - r["x"], l["y"] - r["y"]) <= tol * 1.5)


def _level(y1: Column, y2: Column) -> Column:
    return F.abs(y1 - y2) < 0.02


_STARTS = "doc long, page long, line long, box array<double>, lines array<long>"


def _first_fit(walks: DataFrame) -> DataFrame:
    """Walks (doc, page, line, box, lines) in the order of ``line``, without those that start at a line which a walk that stays has used. A task holds one page, one narrow row for each
    closed walk; everything that searches for walks has been done over joins by then."""

    def of_page(g: pa.Table) -> pa.Table:
        line, lines = g["line"].to_pylist(), g["lines"].to_pylist()
        used, keep, last, free = set(), [], None, False
        for i in sorted(range(len(line)), key=line.__getitem__):
            if line[i] != last:
                last, free = line[i], line[i] not in used
            if free:
                keep.append(i)
                used.update(lines[i])
        return g.take(sorted(keep))

    return walks.groupBy(*KEY).applyInArrow(of_page, _STARTS)


def _boxed(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outlines (doc, page, line, x0, y0, x1, y1) and the lines they use (doc, page, seg_id)."""
    outlines = kept.select(*KEY, "line", *[F.col("box")[i].alias(c) for i, c in enumerate(BOX)])
    return outlines, kept.select(*KEY, F.explode("lines").alias("seg_id")).distinct()


def _box(xa, xb, ya, yb) -> Column:
    return F.array(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def rect_from_lines(lines: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies of colour drawings that are drawn as four single lines (doc, page, seg_id, x1, y1, x2, y2), and the lines used.

    A walk leaves a level line at its second end, turns into an upright, a level and an upright one and is back within 1.5 tolerances (0.03 s, at least 0.1) of its start. Lines are
    tried in order; each takes its first walk, turns in order of cell and number. A line that an outline has used starts no further one; it may still close one, as neighbouring
    bodies share edges. Corners that many lines share are split by page and cell, and only the first walk of a line is kept, so walks are never listed.
    """
    tol = F.greatest(F.lit(0.1), F.col("s") * 0.03)
    e = _ends(lines.join(heights.select(*KEY, tol.alias("tol")), KEY), "seg_id", "tol").withColumn("level", _level(F.col("y"), F.col("fy")))
    turn = lambda l, r: (l["seg_id"] != r["seg_id"]) & _meet(l, r, l["tol"])  # noqa: E731, E741
    j = grid_join(e.where("level"), e.where("not level"), KEY, point_box(grow=F.col("tol") * 2), point_box(), CELL, turn)
    # a turn from a level line into an upright one is also the turn back, so half of them are searched for, once for all three steps of a walk
    i, k = (_step(F.col("l"), F.col("r"), F.col("l.tol"), c).cast("int") for c in "xy")
    t = j.select("l.doc", "l.page", "l.tol", F.col("l.seg_id").alias("level"), F.col("l.e").alias("level_at"), F.col("r.seg_id").alias("upright"), F.col("r.e").alias("upright_at"), F.col("r.fx").alias("fx"), F.col("r.fy").alias("fy"), i.alias("i"), k.alias("k")).persist()
    c = F.col
    into, back = F.struct("i", "k", (c("upright") * 2 + c("upright_at")).alias("n")), F.struct((-c("i")).alias("i"), (-c("k")).alias("k"), (c("level") * 2 + c("level_at")).alias("n"))
    first = t.where("level_at = 1").select(*KEY, c("level").alias("a"), c("upright").alias("b"), (1 - c("upright_at")).alias("b_at"), into.alias("o1"))
    second = t.select(*KEY, c("upright").alias("b"), c("upright_at").alias("b_at"), c("level").alias("c"), (1 - c("level_at")).alias("c_at"), back.alias("o2"))
    third = t.select(*KEY, c("level").alias("c"), c("level_at").alias("c_at"), c("upright").alias("d"), c("fx").alias("dx"), c("fy").alias("dy"), "tol", into.alias("o3"))
    walk = first.join(second, [*KEY, "b", "b_at"]).where("c <> a").join(third, [*KEY, "c", "c_at"]).where("d <> b")
    start = lines.select(*KEY, F.col("seg_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in LINE])
    walk = walk.join(start, [*KEY, "a"]).where(F.hypot(F.col("dx") - F.col("a_x1"), F.col("dy") - F.col("a_y1")) <= F.col("tol") * 1.5)
    best = walk.groupBy(*KEY, "a").agg(F.min(F.struct("o1", "o2", "o3", "b", "c", "d", "a_x1", "a_y1", "a_x2")).alias("w")).select(*KEY, "a", "w.*")
    best = best.join(lines.select(*KEY, F.col("seg_id").alias("c"), F.col("y1").alias("c_y")), [*KEY, "c"])
    return _boxed(_first_fit(best.select(*KEY, F.col("a").alias("line"), _box(F.col("a_x1"), F.col("a_x2"), F.col("a_y1"), F.col("c_y")).alias("box"), F.array("a", "b", "c", "d").alias("lines"))))


def rect_from_wires(wires: DataFrame, texts: DataFrame, parts: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies of monochrome drawings among the wires, and the wires used.

    Ends meet where they round to the same tenth; a walk goes level, upright, level, upright and ends within 0.15 of its start. It is a body if a text of ``texts`` has its
    centre inside, if a part link of ``parts`` (doc, page, x0, y0, x1, y1) holds it, or if it is at most 3 s long. All walks of a wire count, unless an earlier body has used it.
    """
    e = _ends(wires.select(*KEY, "seg_id", *LINE), "seg_id").withColumns({"kx": F.floor(F.col("x") * 10 + 0.5), "ky": F.floor(F.col("y") * 10 + 0.5)})
    level, upright = F.abs(F.col("y") - F.col("fy")) <= 0.02, F.abs(F.col("x") - F.col("fx")) <= 0.02
    # a wire listed twice at one corner (both ends there) is left by the end that is not within 0.15, as any other
    side = lambda keep, n: e.where(keep).select(*KEY, F.col("seg_id").alias(n), "kx", "ky", F.col("fx").alias(f"{n}x"), F.col("fy").alias(f"{n}y"))
    at = lambda df, n: df.withColumns({"kx": F.floor(F.col(f"{n}x") * 10 + 0.5), "ky": F.floor(F.col(f"{n}y") * 10 + 0.5)})
    s = e.where((F.col("e") == 1) & level).select(*KEY, F.col("seg_id").alias("a"), "kx", "ky", F.col("fx").alias("ax"), F.col("fy").alias("ay"), F.col("x").alias("sx"))
    w = at(s.join(side(upright, "b"), [*KEY, "kx", "ky"]).where("a <> b"), "b")
    w = at(w.join(side(level, "c"), [*KEY, "kx", "ky"]).where("b <> c"), "c")
    w = w.join(side(upright, "d"), [*KEY, "kx", "ky"]).where((F.col("c") != F.col("d")) & (F.hypot(F.col("dx") - F.col("ax"), F.col("dy") - F.col("ay")) <= 0.15))
    box = _box(F.col("ax"), F.col("sx"), F.col("ay"), F.col("by"))
    w = w.select(*KEY, F.col("a").alias("line"), box.alias("box"), F.array("a", "b", "c", "d").alias("lines")).withColumn("walk", F.xxhash64("line", "lines"))
    b = w.select(*KEY, "walk", *[F.col("box")[i].alias(c) for i, c in enumerate(BOX)]).distinct()
    centres = texts.select(*KEY, ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    inside = grid_join(centres, b, KEY, point_box(), text_box(), CELL, lambda p, r: (p["x"] > r["x0"]) & (p["x"] < r["x1"]) & (p["y"] > r["y0"]) & (p["y"] < r["y1"]))
    held = grid_join(b, parts.select(*KEY, *BOX), KEY, text_box(), text_box(), CELL, lambda r, p: (r["x0"] >= p["x0"]) & (r["x1"] <= p["x1"]) & (r["y0"] >= p["y0"]) & (r["y1"] <= p["y1"]))
    small = b.join(heights.select(*KEY, "s"), KEY).where(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) <= F.col("s") * 3)
    good = inside.select("r.doc", "r.page", "r.walk").union(held.select("l.doc", "l.page", "l.walk")).union(small.select(*KEY, "walk")).distinct()
    return _boxed(_first_fit(w.join(good, [*KEY, "walk"], "left_semi").select(*KEY, "line", "box", "lines")))


def _tips(diags: DataFrame) -> DataFrame:
    """Arrow tips (doc, page, tip, vi, vj, tx, ty, ax, ay, bx, by, upright, ux, uy, tol, s): two slanted strokes that meet in one point and leave an upright or level base of 0.4 to 3.5 s,
    both as long as each other; (ux, uy) points from the tip along the body."""
    e = _ends(diags, "diag_id", "s", "tol").withColumn("v", F.col("diag_id") * 2 + F.col("e"))
    near = lambda l, r: (l["v"] < r["v"]) & (l["diag_id"] != r["diag_id"]) & _meet(l, r, l["tol"])  # noqa: E731, E741
    j = grid_join(e, e, KEY, point_box(grow=F.col("tol") * 2), point_box(), CELL, near)
    t = j.select("l.doc", "l.page", F.col("l.v").alias("vi"), F.col("r.v").alias("vj"), F.col("l.x").alias("tx"), F.col("l.y").alias("ty"), F.col("l.fx").alias("ax"), F.col("l.fy").alias("ay"), F.col("r.fx").alias("bx"), F.col("r.fy").alias("by"), "l.s", "l.tol")
    c, base = F.col, F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    t = t.withColumns({"upright": F.abs(c("ax") - c("bx")) < c("tol"), "flat": F.abs(c("ay") - c("by")) < c("tol")}).where((c("upright") != c("flat")) & (base >= c("s") * 0.4) & (base <= c("s") * 3.5))
    even = F.abs(F.hypot(c("ax") - c("tx"), c("ay") - c("ty")) - F.hypot(c("bx") - c("tx"), c("by") - c("ty"))) <= c("tol") * 2
    sign = lambda on, d: F.when(on, F.signum(d)).otherwise(0.0)
    t = t.where(even).withColumns({"ux": sign(c("upright"), c("ax") - c("tx")), "uy": sign(c("flat"), c("ay") - c("ty"))})
    return t.where("ux <> 0 or uy <> 0").drop("flat")


def port_outlines(diags: DataFrame, strokes: DataFrame, heights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ports and off-page connectors of monochrome drawings: outlines (doc, page, port, x0, y0, x1, y1), numbered from 1 in the order of their tips, and the strokes they claim (doc, page,
    seg_id). ``diags`` (doc, page, diag_id, x1, y1, x2, y2) are slanted strokes, ``strokes`` (doc, page, seg_id, x1, y1, x2, y2, glyph) level and upright ones,
    those taken for lettering included (glyph).

    From both ends of a tip's base an edge runs away from the tip, 0.5 to 30 s long and as long as the other within 6 %. The outline is closed by strokes on the line through the edges' far ends
    that cover 90 % of it, lettering strokes anywhere on it included, or by a second tip at both far ends; else two stacked ports would make a third of their leads. A pair of edges belongs
    to its first tip. Of outlines that agree on all sides within the tolerance (0.04 s, at least 0.15) the first stays.
    """
    sized = heights.select(*KEY, "s", F.greatest(F.lit(0.15), F.col("s") * 0.04).alias("tol"))
    d, p = diags.select(*KEY, "diag_id", *LINE).join(sized, KEY), strokes.select(*KEY, "seg_id", "glyph", *LINE)
    tip, ends, c = ["vi", "vj"], _ends(p, "seg_id"), F.col
    tips = _tips(d)
    corner = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), c(f"{n}x").alias("x"), c(f"{n}y").alias("y")) for n in "ab"]))
    base = tips.select(*KEY, *tip, "tx", "ty", "upright", "ux", "uy", "s", "tol", corner.alias("p")).select("*", "p.*").drop("p")
    along = lambda l, r: (r["fx"] - l["x"]) * l["ux"] + (r["fy"] - l["y"]) * l["uy"]  # noqa: E731, E741
    aside = lambda l, r: F.abs((r["fx"] - l["x"]) * l["uy"] - (r["fy"] - l["y"]) * l["ux"])  # noqa: E731, E741
    runs = lambda l, r: _meet(l, r, l["tol"]) & (along(l, r) > l["s"] * 0.5) & (along(l, r) < l["s"] * 30) & (aside(l, r) < l["tol"])  # noqa: E731, E741
    edges = grid_join(base, ends, KEY, point_box(grow=c("tol") * 2), point_box(), CELL, runs)
    edges = edges.select("l.*", F.struct(F.col("r.seg_id").alias("n"), along(c("l"), c("r")).alias("len"), c("r.fx").alias("fx"), c("r.fy").alias("fy"), c("l.x").alias("x"), c("l.y").alias("y")).alias("edge")).drop("x", "y")
    a = edges.where("side = 'a'").drop("side").withColumnRenamed("edge", "a")
    b = edges.where("side = 'b'").select(*KEY, *tip, F.col("edge").alias("b"))
    pairs = a.join(b, [*KEY, *tip]).where((c("a.n") != c("b.n")) & (F.abs(c("a.len") - c("b.len")) <= F.greatest(c("tol") * 2, c("a.len") * 0.06)))
    pairs = pairs.withColumns({"id": F.struct("vi", "vj", c("a.n").alias("m"), c("b.n").alias("n")), "line": F.when(c("upright"), c("a.fx")).otherwise(c("a.fy"))})
    ends_of = [F.when(c("upright"), c(f"{n}.fy")).otherwise(c(f"{n}.fx")) for n in "ab"]
    pairs = pairs.withColumns({"lo": F.least(*ends_of), "hi": F.greatest(*ends_of)})
    pairs = written(pairs, "port-edges")
    # strokes on the back: an end near a far end, both ends on the line
    far = pairs.select(*KEY, "id", "upright", "tol", "line", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(n).alias("side"), c(f"{n}.fx").alias("x"), c(f"{n}.fy").alias("y")) for n in "ab"])).alias("p")).select("*", "p.*").drop("p")
    pick = lambda l, u, v: F.when(l["upright"], u).otherwise(v)  # noqa: E731, E741

    def on_back(l, r):  # noqa: E741
        there = (F.abs(_step(l, r, l["tol"], "x")) <= 1) & (F.abs(_step(l, r, l["tol"], "y")) <= 1)
        for x, y in (("x", "y"), ("fx", "fy")):
            across, at = pick(l, r[x], r[y]), pick(l, r[y], r[x])
            there &= (F.abs(across - l["line"]) <= l["tol"]) & (at >= l["lo"] - l["tol"]) & (at <= l["hi"] + l["tol"])
        return there & (r["seg_id"] != l["id"]["m"]) & (r["seg_id"] != l["id"]["n"])

    j = grid_join(far, ends, KEY, point_box(grow=c("tol") * 3), point_box(), CELL, on_back)
    long = F.abs(pick(c("l"), c("r.y") - c("r.fy"), c("r.x") - c("r.fx")))
    back = j.select("l.doc", "l.page", "l.id", "r.seg_id", long.alias("len")).groupBy(*KEY, "id", "seg_id").agg(F.max("len").alias("len"))
    back = back.groupBy(*KEY, "id").agg(F.sum("len").alias("drawn"), F.collect_set("seg_id").alias("behind"))
    # lettering strokes anywhere on the line
    lines = pairs.select(*KEY, "id", "upright", "tol", "line", "lo", "hi")
    shared = lambda l, r: F.least(F.greatest(pick(l, r["y1"], r["x1"]), pick(l, r["y2"], r["x2"])), l["hi"]) - F.greatest(F.least(pick(l, r["y1"], r["x1"]), pick(l, r["y2"], r["x2"])), l["lo"])  # noqa: E731, E741
    covers = lambda l, r: (F.abs(pick(l, r["x1"], r["y1"]) - l["line"]) <= l["tol"]) & (F.abs(pick(l, r["x2"], r["y2"]) - l["line"]) <= l["tol"]) & (shared(l, r) > 0)  # noqa: E731, E741
    upright = F.col("upright")
    reach = (F.when(upright, c("line") - c("tol")).otherwise(c("lo")), F.when(upright, c("lo")).otherwise(c("line") - c("tol")), F.when(upright, c("line") + c("tol")).otherwise(c("hi")), F.when(upright, c("hi")).otherwise(c("line") + c("tol")))
    g = grid_join(lines, p.where("glyph"), KEY, reach, seg_box(), CELL, covers)
    lettered = g.select("l.doc", "l.page", "l.id", shared(c("l"), c("r")).alias("o")).groupBy(*KEY, "id").agg(F.sum("o").alias("lettered"))
    # far ends with a tip
    slanted = _ends(d, "diag_id")
    tipped = grid_join(far, slanted, KEY, point_box(grow=c("tol") * 2), point_box(), CELL, lambda l, r: _meet(l, r, l["tol"])).select("l.doc", "l.page", "l.id", "l.side").distinct().groupBy(*KEY, "id").agg(F.count("*").alias("tipped"))
    full = pairs.join(back, [*KEY, "id"], "left").join(lettered, [*KEY, "id"], "left").join(tipped, [*KEY, "id"], "left")
    drawn, need = F.coalesce("drawn", F.lit(0.0)), (c("hi") - c("lo")) * 0.9
    closed = F.when(drawn >= need, True).otherwise((drawn + F.coalesce("lettered", F.lit(0.0)) >= need) | F.coalesce(c("tipped") == 2, F.lit(False)))
    first = Window.partitionBy(*KEY, F.least("a.n", "b.n"), F.greatest("a.n", "b.n")).orderBy("id")
    full = full.where(closed).withColumn("r", F.row_number().over(first)).where("r = 1")
    xs, ys = ([c(f"t{k}"), c(f"a.{k}"), c(f"b.{k}"), c(f"a.f{k}"), c(f"b.f{k}")] for k in "xy")
    full = full.select(*KEY, "id", "tol", F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), F.concat(F.array("a.n", "b.n"), F.coalesce("behind", F.array().cast("array<long>"))).alias("claims"))
    full = written(full.withColumn("port", F.row_number().over(Window.partitionBy(*KEY).orderBy("id")).cast("long")), "ports")
    alike = lambda l, r: (l["port"] < r["port"]) & (F.greatest(*[F.abs(l[k] - r[k]) for k in BOX]) < r["tol"])  # noqa: E731, E741
    boxes = full.select(*KEY, "port", "tol", *BOX)
    same = grid_join(boxes, boxes, KEY, point_box("x0", "y0"), point_box("x0", "y0", c("tol")), CELL, alike)
    same = dropped_repeats(same.select("l.doc", "l.page", F.col("l.port").alias("earlier"), F.col("r.port").alias("later"))).withColumnRenamed("later", "port")
    ports = boxes.select(*KEY, "port", *BOX).join(same, [*KEY, "port"], "left_anti")
    return ports, full.select(*KEY, F.explode("claims").alias("seg_id")).distinct()


def symbols_outside(symbols: DataFrame, ports: DataFrame, heights: DataFrame) -> DataFrame:
    """``symbols`` (doc, page, sym_id, x0, y0, x1, y1) without those that lie in a port, grown by 1.5 tolerances: the strokes of its tip, which would glue its neighbours together."""
    m = F.greatest(F.lit(0.15), F.col("s") * 0.04) * 1.5
    p = ports.join(heights.select(*KEY, m.alias("m")), KEY).select(*KEY, "m", *BOX)
    inside = lambda l, r: (l["x0"] >= r["x0"] - r["m"]) & (l["x1"] <= r["x1"] + r["m"]) & (l["y0"] >= r["y0"] - r["m"]) & (l["y1"] <= r["y1"] + r["m"])  # noqa: E731, E741
    j = grid_join(symbols.select(*KEY, "sym_id", *BOX), p, KEY, text_box(), text_box(F.col("m")), CELL, inside)
    return symbols.join(j.select("l.doc", "l.page", "l.sym_id").distinct(), [*KEY, "sym_id"], "left_anti")
