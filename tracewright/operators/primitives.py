"""From path records to rows: sub-paths, straight strokes, junction dots, triangles, and what each primitive may be. Keyed by (doc, page)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import KEY
from .spatial import ends, grid_join, point_box

# Numbers that follow each opcode (0 move, 1 line, 2 cubic, 3 quadratic, 4 close); the point it leads to comes last.
ARGS = {0: 2, 1: 2, 2: 6, 3: 4, 4: 0}
PTS = "array<struct<x:double,y:double>>"


def _decoded(b: pa.RecordBatch) -> pa.RecordBatch:
    """The sub-paths of a batch of opcode streams, in view space (y down). Unknown codes are passed over; what comes before a move is dropped. Each place of the streams is taken for an opcode and
    pointed at the one that would follow; those that the first places lead to are found by following two, four, eight .. pointers at once."""
    data = b.column("data")
    size = data.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    v = np.append(data.flatten().to_numpy(zero_copy_only=False), np.nan)
    row = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)
    last = len(v) - 1
    op = np.where(np.abs(v) < 5, v, -1.0).astype(np.int64)  # as int() does, towards 0
    n = np.zeros(len(v), np.int64)
    for code, many in ARGS.items():
        n[op == code] = many
    at = np.arange(last)
    whole = (n[:-1] == 0) | (at + n[:-1] < end[row])
    step = at + n[:-1] + 1
    jump = np.append(np.where(whole & (step < end[row]), step, last), last)
    met = np.zeros(len(v), bool)
    met[(end - size)[size > 0]] = True
    while True:
        more = jump[met]
        if met[more[more < last]].all():
            break
        met[more] = True
        jump = jump[jump]
    k = np.flatnonzero(met[:-1] & whole & (op[:-1] >= 0))
    row, op, to = row[k], op[k], k + n[k]
    move = op == 0
    sub = np.cumsum(move) - 1
    starts = np.flatnonzero(move)
    mine = (sub >= 0) & (row[starts][sub] == row) if len(starts) else np.zeros(len(k), bool)
    row, op, to, sub = row[mine], op[mine], to[mine], sub[mine]
    m = b.column("ctm").flatten().to_numpy(zero_copy_only=False).reshape(-1, 6)[row].T
    height = b.column("height").to_numpy(zero_copy_only=False)[row]
    vx, vy = v[to - 1], v[to]
    x, y = m[0] * vx + m[2] * vy + m[4], height - (m[1] * vx + m[3] * vy + m[5])
    # a close leads back to the start, unless the sub-path is there already
    close, first = op == 4, np.flatnonzero(op == 0)
    away = lambda p, q: np.maximum(np.abs(x[p] - x[q]), np.abs(y[p] - y[q]))
    i = np.flatnonzero(close)
    back = i[~close[i - 1] & (away(first[sub[i]], i - 1) > 1e-3)]
    x[back], y[back] = x[first[sub[back]]], y[first[sub[back]]]
    drawn = ~close
    drawn[back] = True
    closed = np.zeros(len(first), bool)
    closed[sub[i]] = True
    of, x, y, op = sub[drawn], x[drawn], y[drawn], op[drawn]
    count = np.bincount(of, minlength=len(first))
    ends = np.cumsum(count)
    closed |= (count > 3) & (away(ends - count, ends - 1) < 1e-3)
    offsets = lambda c: pa.array(np.append(0, np.cumsum(c)), pa.int32())
    pts = pa.ListArray.from_arrays(offsets(count), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    straight = pa.ListArray.from_arrays(offsets(count - 1), pa.array(((op == 1) | (op == 4))[op != 0]))
    owner = row[first]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keys = [b.column(c).take(pa.array(owner)) for c in ("doc", "page", "path_id")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(nth, pa.int32()), pts, straight, pa.array(closed)], ["doc", "page", "path_id", "sub", "pts", "straight", "closed"])


def decode_path(paths: DataFrame) -> DataFrame:
    """(doc, page, path_id, sub, pts, straight, closed): one row for each sub-path of ``paths`` (doc, page, path_id, data, ctm, height). A null stream or matrix has none; a
    stream cut short ends at its last whole step; more than three points that come back to the start are closed."""

    def run(batches):
        for b in batches:
            yield _decoded(b)

    rows = paths.select(F.col("doc").cast("long"), F.col("page").cast("long"), F.col("path_id").cast("long"), F.col("data").cast("array<double>"), F.col("ctm").cast("array<double>"), F.coalesce(F.col("height").cast("double"), F.lit(0.0)).alias("height"))
    return rows.where("data is not null and size(ctm) = 6").mapInArrow(run, f"doc long, page long, path_id long, sub int, pts {PTS}, straight array<boolean>, closed boolean")


def straight_pieces(subpaths: DataFrame, *more: Column) -> DataFrame:
    """(doc, page, path_id, sub, k, x1, y1, x2, y2, orth): each straight piece of each sub-path; orth if it is level or upright to 0.02. ``more``: further columns of the sub-path."""
    pts, n = F.col("pts"), F.size("straight")
    z = F.arrays_zip(F.slice(pts, F.lit(1), n).alias("a"), F.slice(pts, F.lit(2), n).alias("b"), F.col("straight").alias("s"))
    p = subpaths.where(n > 0).select(*KEY, "path_id", "sub", *more, F.posexplode(z).alias("k", "z")).where("z.s")
    rest = subpaths.select(*more).columns
    c = F.col
    orth = (F.abs(c("z.a.x") - c("z.b.x")) < 0.02) | (F.abs(c("z.a.y") - c("z.b.y")) < 0.02)
    return p.select(*KEY, "path_id", "sub", "k", c("z.a.x").alias("x1"), c("z.a.y").alias("y1"), c("z.b.x").alias("x2"), c("z.b.y").alias("y2"), orth.alias("orth"), *rest)


def raw_orth_segs(paths: DataFrame) -> DataFrame:
    """Level and upright straight strokes of stroked paths (op stroke or fillStroke), for alignment: closing lines do not count."""
    data = F.filter("data", lambda x: x.isNotNull())
    drawn = decode_path(paths.where("op in ('stroke', 'fillStroke')").withColumn("data", data))
    # each piece beside the outline that it is of, which one decoding gives both
    p = straight_pieces(drawn, F.struct("closed", F.size("straight").alias("n"), F.element_at("pts", 1).alias("first")).alias("of"))
    closing = F.col("of.closed") & (F.col("k") == F.col("of.n") - 1) & (F.col("x2") == F.col("of.first.x")) & (F.col("y2") == F.col("of.first.y"))
    return p.where("orth").where(~closing).select(*KEY, "path_id", "sub", "k", "x1", "y1", "x2", "y2")


def bounds(pts: Column | str) -> dict[str, Column]:
    of = lambda c: F.transform(pts, lambda p: p[c])
    return {"x0": F.array_min(of("x")), "y0": F.array_min(of("y")), "x1": F.array_max(of("x")), "y1": F.array_max(of("y"))}


def junction_dots(prims: DataFrame, height: float) -> DataFrame:
    """(doc, page, prim_id, x, y, r): filled primitives that are round (a curve or seven points), about as wide as high, 0.12 to 1.3 of the text height; glyphs are none."""
    b = prims.withColumns(bounds("pts")).withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    round_ = F.exists("straight", lambda s: ~s) | (F.size("pts") >= 7)
    even = F.abs(F.col("w") - F.col("h")) < F.greatest("w", "h") * 0.25
    d = b.where((F.col("op") != "stroke") & ~F.coalesce("glyph", F.lit(False)) & round_ & (F.col("w") > height * 0.12) & (F.col("w") < height * 1.3) & even)
    return d.select(*KEY, "prim_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("w") / 2).alias("r"))


def closed_triangles(prims: DataFrame, height: float) -> DataFrame:
    """(doc, page, prim_id, x0, y0, x1, y1): closed sub-paths of straight pieces with exactly three corners (told apart at 0.05), 0.15 to 1.6 of the text height."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < 0.05) & (F.abs(p["y"] - q["y"]) < 0.05)
    corners = F.aggregate("pts", F.array().cast(PTS), lambda acc, p: F.when(F.exists(acc, lambda q: near(p, q)), acc).otherwise(F.array_append(acc, p)))
    b = prims.where(F.col("closed") & F.forall("straight", lambda s: s) & (F.size(corners) == 3)).withColumns(bounds("pts"))
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return b.where((size > height * 0.15) & (size < height * 1.6)).select(*KEY, "prim_id", "x0", "y0", "x1", "y1")


def route_prims(prims: DataFrame, height: float, diagonal: float, colour: bool) -> DataFrame:
    """(doc, page, prim_id, wire, body, symbol, pin_line, bar): what each primitive (op, pts, straight, closed, glyph, wire_style) may be. Glyphs are nothing; fills are at most
    symbols; closed outlines are bodies, not wires; sheet frames (over 0.45 of the diagonal) are no wires."""
    b = prims.where(~F.coalesce("glyph", F.lit(False))).withColumns(bounds("pts"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size, fill, closed = F.greatest(w, h), F.col("op") == "fill", F.coalesce("closed", F.lit(False))
    style = F.coalesce("wire_style", F.lit(False)) if colour else ~fill
    n = F.size("straight")
    piece = F.arrays_zip(F.slice("pts", F.lit(1), n).alias("a"), F.slice("pts", F.lit(2), n).alias("b"), F.col("straight").alias("s"))
    orth = lambda z: (F.abs(z["a"]["x"] - z["b"]["x"]) < 0.02) | (F.abs(z["a"]["y"] - z["b"]["y"]) < 0.02)
    long_ = lambda z: F.hypot(z["a"]["x"] - z["b"]["x"], z["a"]["y"] - z["b"]["y"])
    odd = F.exists(piece, lambda z: ~z["s"] | ~orth(z))
    some = lambda test: (n > 0) & F.exists(piece, lambda z: z["s"] & test(z))
    box_like = closed & (F.lit(not colour) | ~style)
    flags = {
        "symbol": F.when(fill, size < height * 1.8).otherwise((closed | odd | ~style) & (size < height * 2.2)),
        "bar": ~fill & ~closed & some(lambda z: orth(z) & (long_(z) >= height * 0.2) & (long_(z) <= height * 3)),
        "pin_line": ~fill & F.lit(colour) & ~style & ~closed & some(lambda z: orth(z) & (long_(z) >= height * 0.8)),
        "body": ~fill & box_like & (w > height * 0.8) & (h > height * 0.4),
        "wire": ~fill & ~box_like & style & (size <= diagonal * 0.45) & some(lambda z: (orth(z) | F.lit(colour)) & (long_(z) >= 0.05)),
    }
    return b.select(*KEY, "prim_id", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in sorted(flags.items())])


def ground_bars(bars: DataFrame, height: float) -> DataFrame:
    """(doc, page, level, lane, first, n, shrinks, centre, top): stacks of three bars or more on one axis, 0.08 to 0.8 of the text height apart, that get strictly shorter (shrinks) or longer;
    centre and top are those of the longest bar. ``bars``: doc, page, level (boolean), centre, pos, len.

    A run of bars always reaches to the end of its chain, and one that is neither starts again at its next bar: what counts is the longest end of a chain that keeps its direction. It is found
    without a walk, by the steps that equal the last one, counted from the end. Equal positions end a chain; bars with null coordinates are in none.
    """
    lane = F.floor(F.col("centre") / max(0.2, height * 0.15) + 0.5)
    w = Window.partitionBy(*KEY, "level", "lane").orderBy("pos", "len")
    gap, before = F.col("pos") - F.lag("pos").over(w), F.lag("len").over(w)
    b = bars.dropna(subset=["centre", "pos", "len"]).withColumn("lane", lane)
    b = b.withColumns({"new": F.coalesce((gap < height * 0.08) | (gap > height * 0.8), F.lit(True)).cast("int"), "way": F.when(F.col("len") < before - 0.05, -1).when(F.col("len") > before + 0.05, 1).otherwise(0)})
    b = b.withColumn("chain", F.sum("new").over(w)).withColumn("way", F.when(F.col("new") == 0, F.col("way")))
    run = [*KEY, "level", "lane", "chain"]
    end = Window.partitionBy(*run).orderBy(F.desc("pos"), F.desc("len"))
    last = F.first("way").over(end)
    b = b.withColumn("last", last).withColumn("off", F.sum(F.coalesce((F.col("way") != F.col("last")).cast("int"), F.lit(1))).over(end))
    # the bar before the first step that keeps the direction belongs to the stack as well
    b = b.withColumn("mine", (F.col("off") == 0) | (F.coalesce(F.lag("off").over(end), F.lit(1)) == 0)).where("mine and last <> 0")
    longest = F.struct(F.col("len"), F.col("centre"), F.col("pos"))
    s = b.groupBy(*run).agg(F.min("pos").alias("first"), F.count("*").alias("n"), (F.first("last") < 0).alias("shrinks"), F.max(longest).alias("top"))
    return s.where("n >= 3").select(*KEY, "level", "lane", "first", "n", "shrinks", F.col("top.centre").alias("centre"), F.col("top.pos").alias("top"))


def ground_wires(stacks: DataFrame, segs: DataFrame, height: float) -> DataFrame:
    """(doc, page, level, lane, first, seg_id): for each stack of ``ground_bars`` the wire whose end lies nearest along its stem: on the side of the longest bar, up to 1.6 heights away and hardly
    off the axis. Equally near ends: the first wire. Stacks without such a wire are left out."""
    tol, reach = max(0.2, height * 0.15), height * 1.6
    at = stacks.withColumns({"px": F.when(F.col("level"), F.col("centre")).otherwise(F.col("top")), "py": F.when(F.col("level"), F.col("top")).otherwise(F.col("centre")), "dir": F.when(F.col("shrinks"), -1.0).otherwise(1.0)})
    pick = lambda l, u, v: F.when(l["level"], u).otherwise(v)  # noqa: E731, E741
    along = lambda l, r: pick(l, r["y"] - l["py"], r["x"] - l["px"]) * l["dir"]  # noqa: E731, E741
    near = lambda l, r: (F.abs(pick(l, r["x"] - l["px"], r["y"] - l["py"])) <= tol * 1.5) & (along(l, r) >= -tol) & (along(l, r) <= reach)  # noqa: E731, E741
    j = grid_join(at.select(*KEY, "level", "lane", "first", "px", "py", "dir"), ends(segs), KEY, point_box("px", "py", reach), point_box(), 20.0, near)
    best = j.select("l.doc", "l.page", "l.level", "l.lane", "l.first", along(F.col("l"), F.col("r")).alias("d"), "r.seg_id").groupBy(*KEY, "level", "lane", "first").agg(F.min(F.struct("d", "seg_id")).alias("b"))
    return best.select(*KEY, "level", "lane", "first", "b.seg_id")


def mono_variant(prims: DataFrame) -> DataFrame:
    """The primitives in two scenarios (colour, mono): as drawn, and with every colour black but light fills (#e, #f)."""
    mono = prims.withColumns({"stroke": F.lit("#000000"), "fill": F.when(F.col("fill").rlike("(?i)^#[ef]"), F.col("fill")).otherwise("#000000")})
    return prims.withColumn("scenario", F.lit("colour")).unionByName(mono.withColumn("scenario", F.lit("mono")))


