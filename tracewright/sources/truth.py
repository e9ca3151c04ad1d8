"""True nets from CAD sources: the list of drawings, readers for three text formats, nets from bare geometry, and the fit of a source onto its drawing.

Readers take files (doc, content) and give tables keyed by doc: wires (x1, y1, x2, y2, and net where the source states it), junctions (x, y), labels (name, x, y) and parts
(ref, value). A null or empty content gives no rows; rows keep the order of the file in ``at``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text_rules import plain_name
from ..operators.graph import KEY, connected_components
from ..operators.spatial import dist_point_seg, grid_join, join_endpoints, point_box, seg_box
from .shared import written

MANIFEST = "about string, entries array<struct<id:string,tool:string,repo:string,commit:string,pdf:string,source:string,local:boolean,sheet:int,note:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each drawing of a JSON list {"entries": [...]}; a file without entries gives no rows."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def manifest_filter(entries: DataFrame, words: list[str], files: DataFrame | None = None) -> DataFrame:
    """Entries whose id holds any of ``words`` (all, if there are none) with the paths of their files: local drawings lie where they say, others under their id with
    the extension of the original. With ``files`` (path) only entries whose drawing exists."""
    ext = lambda c: F.regexp_extract(c, r"(\.[^./]+)$", 1)
    e = entries.where(F.greatest(F.lit(False), *[F.contains("id", F.lit(w)) for w in words], F.lit(False))) if words else entries
    e = e.withColumn("pdf_path", F.when(F.coalesce("local", F.lit(False)), F.col("pdf")).otherwise(F.concat(F.lit("corpus/files/"), "id", ext("pdf"))))
    e = e.withColumn("source_path", F.when(F.col("source").isNotNull(), F.concat(F.lit("corpus/files/"), "id", ext("source"))))
    return e if files is None else e.join(files.select(F.col("path").alias("pdf_path")).distinct(), "pdf_path", "left_semi").select(e.columns)


def reader_of(name: Column, content: Column) -> Column:
    """sexpr, legacy or eagle by the name of a file and what it starts with or holds; null for other formats, which callers list as errors."""
    return F.when(name.rlike(r"(?i)\.kicad_sch$"), "sexpr").when(F.startswith(content, F.lit("EESchema")), "legacy").when(content.rlike("<eagle "), "eagle")


def read_legacy(files: DataFrame) -> dict[str, DataFrame]:
    """Line-oriented sources: a marker line is followed by its payload; $Comp .. $EndComp blocks hold reference, place and value. Supply symbols (#PWR, power:) give
    labels, other # references nothing; of equal references the first value counts. Each file is read once: its marked lines, each beside the next one, and its blocks are written as they stand."""
    line, none = F.split("content", "\r?\n"), F.array().cast("array<string>")
    # a component is one piece of the text; its fields are found inside it
    blocks = F.regexp_extract_all("content", F.lit(r"(?ms)^\$Comp(.*?)^\$EndComp"), F.lit(1))
    row = lambda line, after, b: F.arrays_zip(line.alias("line"), after.alias("next"), b.alias("b"))
    pieces = files.select("doc", F.posexplode(F.concat(row(line, F.slice(line, F.lit(2), F.size(line)), none), row(none, none, blocks))).alias("at", "p")).select("doc", "at", "p.*")
    pieces = written(pieces.where(F.col("b").isNotNull() | F.col("line").rlike(r"^(Wire Wire Line|Text (Label|GLabel|HLabel)|Connection ~)")), "legacy")
    lines = pieces.where("b is null")
    mark = lines.where("next is not null")
    field = lambda c, i: F.get(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), F.lit(i))
    num = lambda c, i: field(c, i).try_cast("double")
    wires = mark.where(F.startswith("line", F.lit("Wire"))).select("doc", "at", *[num("next", i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    labels = mark.where(F.startswith("line", F.lit("Text"))).select("doc", "at", F.trim("next").alias("name"), num("line", 2).alias("x"), num("line", 3).alias("y"))
    junctions = lines.where(F.startswith("line", F.lit("Connection ~"))).select("doc", "at", num("line", 2).alias("x"), num("line", 3).alias("y"))
    block = pieces.where("b is not null").select("doc", "at", "b")
    got = lambda p, i=1: F.regexp_extract("b", "(?m)" + p, i)
    shown = got(r'^F 0 .*?"([^"]*)"')
    comp = block.select("doc", "at", F.coalesce(F.nullif(shown, F.lit("")), got(r"^L (\S*) (\S*)", 2)).alias("ref"), got(r"^L (\S*)").alias("lib"), got(r"^P (\S+) (\S+)").try_cast("double").alias("x"), got(r"^P (\S+) (\S+)", 2).try_cast("double").alias("y"), got(r'^F 1 .*?"([^"]*)"').alias("value"))
    power = F.startswith("ref", F.lit("#PWR")) | F.col("lib").rlike("(?i)power:")
    names = comp.where(power & (F.col("value") != "") & ~F.col("value").rlike("(?i)PWR_FLAG")).select("doc", (F.col("at") + 1_000_000_000).alias("at"), F.col("value").alias("name"), "x", "y")
    part = comp.where(~power & ~F.startswith("ref", F.lit("#"))).select("doc", "at", F.regexp_replace("ref", r"\?$", "").alias("ref"), F.nullif("value", F.lit("")).alias("value"))
    return {"wires": wires, "junctions": junctions, "labels": labels.unionByName(names), "parts": _first_values(part)}


def _first_values(parts: DataFrame) -> DataFrame:
    first = F.min_by(F.when(F.col("value").isNotNull(), plain_name(F.col("value"))), F.when(F.col("value").isNotNull(), F.col("at")))
    return parts.groupBy("doc", "ref").agg(F.min("at").alias("at"), first.alias("value"))


_TOKEN = re.compile(r'[()]|"(?:[^"\\]|\\.)*"|[^\s()"]+', re.S)


def _nested(text: str) -> list:
    """The lists of an s-expression; what is not closed ends with the text."""
    stack: list[list] = [[]]
    top = stack[0]
    for t in _TOKEN.findall(text):
        if t == "(":
            top = []
            stack.append(top)
        elif t == ")":
            if len(stack) > 1:
                done = stack.pop()
                top = stack[-1]
                top.append(done)
        elif t[0] == '"':
            top.append(re.sub(r"\\(.)", r"\1", t[1:-1], flags=re.S) if "\\" in t else t[1:-1])
        else:
            top.append(t)
    while len(stack) > 1:
        done = stack.pop()
        stack[-1].append(done)
    return stack[0][0] if stack[0] and isinstance(stack[0][0], list) else []


def _sexpr_rows(text: str):
    """(what, name, value, x1, y1, x2, y2) of a schematic."""
    root = _nested(text)
    kids = lambda e, name: [c for c in e if isinstance(c, list) and c and c[0] == name]
    kid = lambda e, name: next(iter(kids(e, name)), [])
    place = lambda e: [float(v) for v in kid(e, "at")[1:4]]
    pins = {}
    for s in kids(kid(root, "lib_symbols"), "symbol"):
        units = [(int(m[1]) if (m := re.search(r"_(\d+)_\d+$", u[1])) else 0, u) for u in kids(s, "symbol")]
        pins[s[1]] = (bool(kids(s, "power")), [(n, *place(p)[:2]) for n, u in units for p in kids(u, "pin")])
    for e in (x for x in root if isinstance(x, list) and x):
        if e[0] == "wire":
            (ax, ay), (bx, by) = [(float(p[1]), float(p[2])) for p in kids(kid(e, "pts"), "xy")[:2]]
            yield ("wire", None, None, ax, ay, bx, by)
        elif e[0] == "junction":
            yield ("junction", None, None, *place(e)[:2], None, None)
        elif e[0] in ("label", "global_label", "hierarchical_label"):
            yield ("label", e[1], None, *place(e)[:2], None, None)
        elif e[0] == "symbol":
            x, y, turn = [*place(e), 0.0][:3]
            prop = {p[1]: p[2] for p in reversed(kids(e, "property"))}
            ref, value = prop.get("Reference", ""), prop.get("Value")
            power, own = pins.get((kid(e, "lib_id") + [None, None])[1], (False, []))
            if power or ref.startswith("#PWR"):
                unit = int((kid(e, "unit") + ["1", "1"])[1])
                dx, dy = next(((px, -py) for n, px, py in own if n in (0, unit)), (0.0, 0.0))
                flip = (kid(e, "mirror") + ["", ""])[1]
                dx, dy = (-dx if flip == "y" else dx), (-dy if flip == "x" else dy)
                a = np.radians(-turn)
                if value and "PWR_FLAG" not in value.upper():
                    yield ("label", value, None, x + dx * np.cos(a) - dy * np.sin(a), y + dx * np.sin(a) + dy * np.cos(a), None, None)
            elif ref and not ref.startswith("#"):
                yield ("part", ref, value or None, None, None, None, None)


def read_sexpr(files: DataFrame) -> dict[str, DataFrame]:
    """Nested sources, one file a task row; labels of supply symbols stand at their pin, turned and mirrored with the symbol."""

    def run(frames):
        for f in frames:
            for doc, text in zip(f["doc"], f["content"], strict=True):
                rows = [(doc, i, *r) for i, r in enumerate(_sexpr_rows(text or ""))]
                yield pd.DataFrame(rows, columns=["doc", "at", "what", "name", "value", "x1", "y1", "x2", "y2"])

    rows = files.select(F.col("doc").cast("long").alias("doc"), "content").mapInPandas(run, "doc long, at long, what string, name string, value string, x1 double, y1 double, x2 double, y2 double")
    rows = written(rows, "sexpr")  # each file is parsed once for all four tables
    point = [F.col("x1").alias("x"), F.col("y1").alias("y")]
    return {
        "wires": rows.where("what = 'wire'").select("doc", "at", "x1", "y1", "x2", "y2"), "junctions": rows.where("what = 'junction'").select("doc", "at", *point),
        "labels": rows.where("what = 'label'").select("doc", "at", "name", *point), "parts": _first_values(rows.where("what = 'part'").select("doc", "at", F.col("name").alias("ref"), "value")),
    }


def read_eagle(files: DataFrame, sheet: int = 0) -> dict[str, DataFrame]:
    """XML sources, of which one sheet counts: nets are stated, curved wires are skipped, instances of parts (a reference of letters and digits) are listed. Nets are
    named if they have a label or a name other than N$."""
    attr = lambda c, n: F.regexp_extract(c, rf'(?:^|\s){n}="([^"]*)"', 1)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    every = lambda c, p, i=1: F.regexp_extract_all(c, F.lit(p), F.lit(i))
    s = files.select("doc", F.get(every("content", r"(?s)<sheet>(.*?)</sheet>"), F.lit(sheet)).alias("s")).where("s is not null")
    nets = s.select("doc", F.posexplode(F.arrays_zip(every("s", r"(?s)<net ([^>]*)>(.*?)</net>").alias("a"), every("s", r"(?s)<net ([^>]*)>(.*?)</net>", 2).alias("b"))).alias("net", "n"))
    nets = nets.select("doc", "net", plain(attr(F.col("n.a"), "name")).alias("name"), F.col("n.b").alias("b"))
    wires = nets.select("doc", "net", F.posexplode(every("b", r"<wire ([^>]*)/>")).alias("at", "w")).where(attr(F.col("w"), "curve") == "")
    wires = wires.select("doc", "net", "at", *[attr(F.col("w"), n).try_cast("double").alias(n) for n in ("x1", "y1", "x2", "y2")])
    labels = nets.select("doc", "net", "name", F.posexplode(every("b", r"<label ([^>]*)/?>")).alias("at", "l")).select("doc", "net", "at", "name", *[attr(F.col("l"), n).try_cast("double").alias(n) for n in ("x", "y")])
    named = nets.select("doc", "net", F.when(F.contains("b", F.lit("<label ")) | ((F.col("name") != "") & ~F.col("name").rlike(r"^N\$")), F.col("name")).alias("name"))
    part = s.select("doc", F.posexplode(every("s", r"<instance ([^>]*?)/?>")).alias("at", "i")).select("doc", "at", attr(F.col("i"), "part").alias("ref")).where(F.col("ref").rlike(r"(?i)^[A-Z]+\d+[A-Z]?$"))
    return {"wires": wires, "labels": labels, "nets": named, "parts": part.groupBy("doc", "ref").agg(F.min("at").alias("at")).withColumn("value", F.lit(None).cast("string"))}


def gt_connect(wires: DataFrame, junctions: DataFrame, labels: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Wires (doc, page, seg_id, x1 ..) with net_id, and (doc, page, net_id, name) of each name of each net: ends that touch join, wires through a junction join,
    wires under labels of one name in any case join. A label names the first wire that it lies on."""
    on = lambda d, s: dist_point_seg(d["x"], d["y"], s["x1"], s["y1"], s["x2"], s["y2"]) <= eps
    s = wires.select(*KEY, "seg_id", "x1", "y1", "x2", "y2").persist()
    hit = grid_join(junctions.select(*KEY, "x", "y"), s, KEY, point_box(grow=eps), seg_box(), 20.0, on).select("l.*", "r.seg_id")
    star = lambda h, *by: h.withColumn("src", F.min("seg_id").over(Window.partitionBy(*KEY, *by))).where("src <> seg_id").select(*KEY, "src", F.col("seg_id").alias("dst"))
    named = grid_join(labels.select(*KEY, "name", "x", "y"), s, KEY, point_box(grow=eps), seg_box(), 20.0, on).select("l.*", "r.seg_id")
    named = named.groupBy(*KEY, "name", "x", "y").agg(F.min("seg_id").alias("seg_id")).withColumn("key", F.upper("name")).persist()
    edges = join_endpoints(s, eps).unionByName(star(hit, "x", "y")).unionByName(star(named, "key"))
    root = connected_components(s, edges).persist()
    first = root.groupBy(*KEY, "root").agg(F.min("seg_id").alias("first"))
    ids = first.withColumn("net_id", (F.row_number().over(Window.partitionBy(*KEY).orderBy("first")) - 1).cast("long")).select(*KEY, "root", "net_id")
    numbered = root.join(ids, [*KEY, "root"]).select(*KEY, "seg_id", "net_id")
    return wires.join(numbered, [*KEY, "seg_id"]), named.join(numbered, [*KEY, "seg_id"]).select(*KEY, "net_id", plain_name(F.col("name")).alias("name")).distinct()


LONGEST, SHORTEST, SAMPLE = 12, 5.0, 80


class _Near:
    """Points in square cells; asks whether, and which, point lies within a distance, at most a cell away."""

    def __init__(self, pts: np.ndarray, cell: float = 1.0):
        pts = pts[np.sort(np.unique(pts, axis=0, return_index=True)[1])]
        keys = np.floor(pts / cell).astype(np.int64) @ np.array([1 << 32, 1])
        order = np.argsort(keys, kind="stable")
        self.cell, self.pts, self.keys = cell, pts[order], keys[order]

    def _around(self, x: np.ndarray):
        """Of each point of x (.., 2) the points in its cell and the eight around it, one at a time: which have one, and which one."""
        at = np.floor(x / self.cell).astype(np.int64) @ np.array([1 << 32, 1])
        for step in ((i << 32) + j for i in (-1, 0, 1) for j in (-1, 0, 1)):
            lo, hi = np.searchsorted(self.keys, at + step), np.searchsorted(self.keys, at + step, "right")
            for k in range(int((hi - lo).max(initial=0))):
                yield lo + k < hi, np.minimum(lo + k, len(self.pts) - 1)

    def votes(self, x: np.ndarray, r: float) -> np.ndarray:
        """How many points of each row of x (rows, points, 2) have a point within r."""
        hit = np.zeros(x.shape[:2], bool)
        for there, i in self._around(x):
            hit |= there & (((self.pts[i] - x) ** 2).sum(axis=2) <= r * r)
        return hit.sum(axis=1)

    def most_votes(self, x: np.ndarray, r: float, above: int) -> tuple[int, int] | None:
        """The first row of x with the most votes, and how many, if they are more than ``above``. Rows that can't reach the most any more are not looked at further."""
        rows, votes, least = np.arange(len(x)), np.zeros(len(x), np.int64), above + 1
        for at in range(0, x.shape[1], 8):
            votes[rows] += self.votes(x[rows, at : at + 8], r)
            if not at and len(rows):
                least = max(least, int(self.votes(x[[votes.argmax()]], r)[0]))
            rows = rows[votes[rows] + max(0, x.shape[1] - at - 8) >= least]
            if not len(rows):
                return None
        best = int(rows[votes[rows].argmax()]) if len(rows) else None
        return None if best is None else (best, int(votes[best]))

    def nearest(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Which of the points x (points, 2) have a point within r, and of these the nearest, of equally near ones the first."""
        best, which = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        for there, i in self._around(x):
            d = ((self.pts[i] - x) ** 2).sum(axis=1)
            nearer = there & (d <= r * r) & (d < best)
            best[nearer], which[nearer] = d[nearer], i[nearer]
        found = best < np.inf
        return found, self.pts[which[found]]


def _fit(truth: np.ndarray, drawn: np.ndarray, unit: float | None, down: bool):
    """(a, b, c, d, e, f, inliers, total): the similarity that lays the truth's segments on the drawn ones."""
    ends = truth.reshape(-1, 2)
    drawn = drawn[np.hypot(*(drawn[:, 2:] - drawn[:, :2]).T) > SHORTEST]
    if not len(ends) or not len(drawn):
        return None
    near, sample, sign = _Near(drawn.reshape(-1, 2)), ends[:: max(1, len(ends) // SAMPLE)], 1.0 if down else -1.0
    best, top = None, -1
    unit_off = lambda scale: (scale < unit * 0.3) | (scale > unit * 1.05)
    length = np.hypot(*(truth[:, 2:] - truth[:, :2]).T)
    for g in truth[np.argsort(-length, kind="stable")[:LONGEST]]:
        span = float(np.hypot(*(g[2:] - g[:2])))
        for turn in (0,) if unit else (0, 90, 180, 270):
            r = np.radians(turn)
            one = np.array([[np.cos(r), -np.sin(r) * sign], [np.sin(r), np.cos(r) * sign]])
            way = one @ (g[2:] - g[:2])
            q0 = np.concatenate([drawn[:, :2], drawn[:, 2:]])
            step = np.concatenate([drawn[:, 2:], drawn[:, :2]]) - q0
            scale = np.hypot(*step.T) / span if span else np.zeros(len(q0))
            level = np.abs(step[:, 1]) < np.abs(step[:, 0])
            ok = (scale > 0) & (step @ way > 0) & (level == (abs(way[1]) < abs(way[0])))
            ok &= ~unit_off(scale) if unit else True
            q0, scale = q0[ok], scale[ok]
            off = q0 - scale[:, None] * (one @ g[:2])
            for at in range(0, len(q0) if top < len(sample) else 0, 1024):  # nothing has more votes than all
                laid = scale[at : at + 1024, None, None] * (sample @ one.T) + off[at : at + 1024, None]
                if (found := near.most_votes(laid, 0.9, top)) is not None:
                    k, top = found
                    best = (one, float(scale[at + k]), off[at + k])
    if best is None:
        return None
    one, scale, off = best
    for _ in range(3):
        found, dst = near.nearest(ends @ (scale * one).T + off, 1.0)
        if len(dst) < 4:
            break
        src = ends[found] @ one.T
        a, b = src - src.mean(axis=0), dst - dst.mean(axis=0)
        scale = float((a * b).sum() / (a * a).sum()) if (a * a).sum() else scale
        off = dst.mean(axis=0) - scale * src.mean(axis=0)
    inliers = near.nearest(ends @ (scale * one).T + off, 0.75)[0].sum()
    m = scale * one
    return (m[0, 0], m[1, 0], m[0, 1], m[1, 1], off[0], off[1], inliers, len(ends))


def fit_transform(truth: DataFrame, drawn: DataFrame, unit: float | None, down: bool = True) -> DataFrame:
    """(doc, page, a, b, c, d, e, f, inliers, total) of each sheet that can be fitted: hypotheses lay one of the longest true wires on a drawn segment, sample points vote,
    least squares refine. A task holds one sheet's wires and strokes; sheets without either have no row."""

    def of_sheet(key, t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        cols = ["x1", "y1", "x2", "y2"]
        got = _fit(t[cols].to_numpy(float), d[cols].to_numpy(float), unit, down)
        return pd.DataFrame([] if got is None else [(*key, *map(float, got[:6]), *map(int, got[6:]))], columns=["doc", "page", *"abcdef", "inliers", "total"])

    schema = "doc long, page long, a double, b double, c double, d double, e double, f double, inliers long, total long"
    side = lambda x: x.select(F.col("doc").cast("long"), F.col("page").cast("long"), "x1", "y1", "x2", "y2").groupBy("doc", "page")
    return side(truth).cogroup(side(drawn)).applyInPandas(of_sheet, schema)


def fit_gate(fits: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Fits with more than ``least`` of their points on the drawing, and the others with their share."""
    f = fits.withColumn("share", F.col("inliers") / F.col("total"))
    return f.where(F.col("share") > least), f.where(~(F.col("share") > least) | F.col("share").isNull())
