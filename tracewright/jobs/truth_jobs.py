"""Queries on CAD sources, path records and values: texts and records are derived from the drawings, so the tables they were made of check the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import primitives as P
from ..operators import values as V
from ..sources import truth as T
from ..sources.fixtures import table, tables, with_ctes
from . import oracle as O
from .oracle import dist
from .part_jobs import _P, value_candidates


def _files(*lines):
    """One file for each sheet from tables (doc, page, o, line): its lines by kind and order; doc is the number of the sheet."""
    whole = lines[0]
    for x in lines[1:]:
        whole = whole.unionByName(x)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o", "line"))), lambda x: x["line"]), "\n")
    return whole.groupBy((F.col("doc") * 5 + F.col("page")).alias("doc")).agg(text.alias("content"))


def _line(df, k, o, *parts):
    return df.select("doc", "page", F.lit(k).alias("k"), F.col(o).cast("long").alias("o"), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("line"))


_n = lambda c: F.col(c).cast("long").cast("string")


def _legacy(spark, sf):
    s, d, t, p = tables(spark, sf, "segs", "dots", "texts", "parts")
    head = _line(s.where("seg_id = 0"), 0, "seg_id", "EESchema Schematic File Version 4")
    wires = _line(s, 1, "seg_id", "Wire Wire Line\n\t", _n("x1"), " ", _n("y1"), " ", _n("x2"), "   ", _n("y2"))
    dots = _line(d.withColumn("o", F.col("x") * 1000 + F.col("y")), 2, "o", "Connection ~ ", _n("x"), " ", _n("y"))
    labels = _line(t, 3, "text_id", F.when(F.col("text_id") % 2 == 0, "Text Label ").otherwise("Text GLabel "), _n("ax"), " ", _n("ay"), " 0    50   ~ 0\n", F.col("str"))
    power = _line(t.where("text_id % 7 = 0"), 4, "text_id", "$Comp\nL power:", F.col("str"), " #PWR0", _n("text_id"), "\nU 1 1 5C3B\nP ", _n("ax"), " ", _n("ay"), '\nF 0 "#PWR0', _n("text_id"), '" H 10\nF 1 "', F.col("str"), '" H 20\n$EndComp')
    comp = _line(p, 5, "i", "$Comp\nL Device:R ", F.when(F.col("i") % 5 == 0, F.lit("R?")).otherwise(F.col("ref")), "\nP ", _n("x"), " ", _n("y"), '\nF 0 "', F.col("ref"), '" V 1\nF 1 "', F.coalesce("value", F.lit("")), '" V 2\n$EndComp')
    return _files(head, wires, dots, labels, power, comp)


def _rows(got):
    n = lambda *c: [F.col(x).cast("double") if x else F.lit(None).cast("double") for x in c]
    cols = ["x1", "y1", "x2", "y2"]
    row = lambda df, what, name, value, *c: df.select("doc", F.lit(what).alias("what"), name.cast("string").alias("name"), value.cast("string").alias("value"), *[v.alias(k) for k, v in zip(cols, n(*c), strict=True)])
    none = F.lit(None)
    out = row(got["wires"], "wire", none, none, *cols).unionByName(row(got["labels"], "label", F.col("name"), none, "x", "y", None, None)).unionByName(row(got["parts"], "part", F.col("ref"), F.col("value"), None, None, None, None))
    return out.unionByName(row(got["junctions"], "junction", none, none, "x", "y", None, None)) if "junctions" in got else out


def src_kicad_legacy(spark, sf):
    return _rows(T.read_legacy(_legacy(spark, sf)))


def _sexpr(spark, sf):
    s, d, t, p = tables(spark, sf, "segs", "dots", "texts", "parts")
    head = _line(s.where("seg_id = 0"), 0, "seg_id", '(kicad_sch (version 20211123)\n(lib_symbols (symbol "power:X" (power) (pin_names) (symbol "X_0_1" (pin power_in line (at 3 4 90) (length 0)))))')
    wires = _line(s, 1, "seg_id", "(wire (pts (xy ", _n("x1"), " ", _n("y1"), ") (xy ", _n("x2"), " ", _n("y2"), ")) (stroke (width 0)))")
    dots = _line(d.withColumn("o", F.col("x") * 1000 + F.col("y")), 2, "o", "(junction (at ", _n("x"), " ", _n("y"), ") (diameter 0))")
    labels = _line(t, 3, "text_id", F.when(F.col("text_id") % 2 == 0, '(label "').otherwise('(global_label "'), F.col("str"), '" (at ', _n("ax"), " ", _n("ay"), " 0))")
    power = _line(t.where("text_id % 7 = 0"), 4, "text_id", '(symbol (lib_id "power:X") (at ', _n("ax"), " ", _n("ay"), " 90) (mirror x) (unit 1)\n", '(property "Reference" "#PWR1") (property "Value" "', F.col("str"), '"))')
    comp = _line(p, 5, "i", '(symbol (lib_id "Device:R") (at 1 2 0) (property "Reference" "', F.col("ref"), '") (property "Value" "', F.coalesce("value", F.lit("")), '") (property "Note" "a \\"quoted\\" (word)"))')
    tail = _line(s.where("seg_id = 0"), 6, "seg_id", ")")
    return _files(head, wires, dots, labels, power, comp, tail)


def src_kicad_sexpr(spark, sf):
    return _rows(T.read_sexpr(_sexpr(spark, sf))).withColumns({c: F.round(c, 6) for c in ("x1", "y1")})


def _eagle(spark, sf):
    s, p = tables(spark, sf, "segs", "parts")
    head = _line(s.where("seg_id = 0"), 0, "seg_id", '<?xml version="1.0"?><eagle version="9"><parts><part name="R1"/></parts><sheets><sheet>')
    inst = _line(p, 1, "i", '<instance part="', F.col("ref"), '" gate="G$1"/>')
    wire = F.concat(F.lit('<segment><wire x1="'), _n("x1"), F.lit('" y1="'), _n("y1"), F.lit('" x2="'), _n("x2"), F.lit('" y2="'), _n("y2"), F.when(F.col("seg_id") % 9 == 4, F.lit('" curve="90"/>')).otherwise('"/>'), F.when(F.col("seg_id") % 6 == 0, F.concat(F.lit('<label x="'), _n("x1"), F.lit('" y="'), _n("y1"), F.lit('" size="1"/>'))).otherwise(""), F.lit("</segment>"))
    net = F.when(F.col("net") % 3 == 0, F.concat(F.lit("N$"), F.col("net").cast("string"))).otherwise(F.concat(F.lit("A&amp;B"), F.col("net").cast("string")))
    nets = s.withColumn("net", F.floor(F.col("seg_id") / 4)).groupBy("doc", "page", "net").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", wire.alias("w")))), lambda x: x["w"]), "\n").alias("ws"))
    return _files(head, inst, _line(nets, 2, "net", '<net name="', net, '" class="0">\n', F.col("ws"), "</net>"), _line(s.where("seg_id = 0"), 3, "seg_id", "</sheet><sheet><net name=\"Z\"></net></sheet></sheets></eagle>"))


def src_eagle_xml(spark, sf):
    return _rows(T.read_eagle(_eagle(spark, sf)))


def src_dispatch(spark, sf):
    """Reader of each of a mixed set of files, error for those of an unknown format."""
    part = lambda df, n, name: df.where(f"doc % 3 = {n}").select("doc", F.concat(F.lit("s"), F.col("doc").cast("string"), F.lit(name)).alias("name"), "content")
    files = part(_legacy(spark, sf), 0, ".sch").unionByName(part(_sexpr(spark, sf), 1, ".KICAD_SCH")).unionByName(part(_eagle(spark, sf), 2, ".sch"))
    files = files.unionByName(files.select("doc", F.lit("x.pdf").alias("name"), F.lit("%PDF").alias("content")))
    return files.select("doc", "name", F.coalesce(T.reader_of(F.col("name"), F.col("content")), F.lit("error")).alias("reader"))


def manifest_filter(spark, sf):
    p = table(spark, sf, "parts")
    e = p.select(F.concat_ws("-", F.lit("sheet"), F.lower("ref"), F.col("doc").cast("string"), F.col("page").cast("string")).alias("id"), F.concat(F.lit("dir/a.b/"), "ref", F.lit(".pdf")).alias("pdf"), F.when(F.col("i") % 3 > 0, F.concat("ref", F.lit(".kicad_sch"))).alias("source"), (F.col("i") % 4 == 0).alias("local"))
    return T.manifest_filter(e, ["-r", "u1"]).select("id", "pdf_path", "source_path")


def gt_connect(spark, sf):
    s, d = tables(spark, sf, "segs", "dots")
    named = s.where("seg_id % 5 = 0").select("doc", "page", F.concat(F.lit("~{n}"), (F.col("seg_id") % 40).cast("string")).alias("name"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    wires, names = T.gt_connect(s, d, named, 0.15)
    return wires.groupBy("doc", "page", "net_id").agg(F.count("*").alias("n")).join(names.groupBy("doc", "page", "net_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")), ["doc", "page", "net_id"], "left")


def fit_transform(spark, sf):
    """Sources at half the scale, moved by (20, -15), laid back on their drawings."""
    s = table(spark, sf, "segs")
    half = s.select("doc", "page", *[((F.col(c) - (40 if c[0] == "x" else -30)) / 2).alias(c) for c in ("x1", "y1", "x2", "y2")])
    f, _ = T.fit_gate(T.fit_transform(half, s, 2.0))
    return f.select("doc", "page", *[(F.round(c, 6) + 0.0).alias(c) for c in "abcdef"], "inliers", "total")


def fit_gate(spark, sf):
    f = table(spark, sf, "pins").groupBy("doc", "page").agg(F.count("*").alias("total"), F.sum((F.col("pred") == 1).cast("long")).alias("inliers")).withColumn("inliers", F.when(F.col("page") % 2 == 0, F.col("inliers") * 3).otherwise(F.col("inliers")))
    good, bad = T.fit_gate(f)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).select("doc", "page", F.round("share", 6).alias("share"), "ok")


def _paths(spark, sf):
    """Each segment as a path: its line, a curve, a step back and, for some, a closing; sheets are 842 high, y upwards."""
    s = table(spark, sf, "segs")
    f = [F.lit(float(v)) for v in range(5)]
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    data = F.concat(F.array(f[0], x1, y1, f[1], x2, y2, f[2], x2, y2, x2, y2, x2 + 3, y2 + 4, f[1], x2 + 3, y2 + 9), F.when(F.col("seg_id") % 3 == 0, F.array(f[4])).otherwise(F.array().cast("array<double>")), F.array(f[0], x1, y1 + 2, f[1], x1 + 5, y1 + 2))
    ctm = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 10, 20)])
    return s.select("doc", "page", F.col("seg_id").alias("path_id"), data.alias("data"), ctm.alias("ctm"), F.lit(842.0).alias("height"), F.when(F.col("seg_id") % 4 == 1, "fill").otherwise("stroke").alias("op"))


def decode_path(spark, sf):
    return P.straight_pieces(P.decode_path(_paths(spark, sf)))


def raw_orth_segs(spark, sf):
    return P.raw_orth_segs(_paths(spark, sf))


def _prims(spark, sf):
    """Outlines around dots: squares, triangles, eight-sided dots and lines by turns, some filled."""
    d = table(spark, sf, "marks")
    pt = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    ring = lambda *ps: F.array(*[pt(*p) for p in ps])
    k = F.col("sym_id") % 4
    pts = F.when(k == 0, ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))).when(k == 1, ring((0, 0), (4, 0), (2, 3), (0, 0))).when(k == 2, ring((1, 0), (3, 0), (4, 1), (4, 3), (3, 4), (1, 4), (0, 3), (0, 1), (1, 0))).otherwise(ring((0, 0), (12, 0)))
    return d.select("doc", "page", F.col("sym_id").alias("prim_id"), F.when(F.col("sym_id") % 3 == 0, "stroke").otherwise("fill").alias("op"), pts.alias("pts"), F.transform(F.slice(pts, F.lit(2), F.size(pts) - 1), lambda _: F.lit(True)).alias("straight"), (k != 3).alias("closed"), (F.col("sym_id") % 5 == 0).alias("glyph"), (F.col("sym_id") % 2 == 1).alias("wire_style"))


def junction_dots(spark, sf):
    return P.junction_dots(_prims(spark, sf), 5.0)


def closed_triangles(spark, sf):
    return P.closed_triangles(_prims(spark, sf), 5.0)


def route_prims(spark, sf):
    return P.route_prims(_prims(spark, sf), 4.0, 1000.0, True)


def mono_variant(spark, sf):
    s = table(spark, sf, "strokes").select("doc", "page", "prim_id", F.col("color").alias("stroke"), F.when(F.col("prim_id") % 3 == 0, "#FEFEFE").when(F.col("prim_id") % 3 == 1, F.col("color")).alias("fill"))
    return P.mono_variant(s).groupBy("doc", "page", "scenario", "stroke", "fill").agg(F.count("*").alias("n"))


def _pairs(spark, sf):
    return value_candidates(spark, sf).select("doc", "page", F.col("i").cast("long").alias("part"), F.col("vid").cast("long").alias("value"), "cost")


def value_assign(spark, sf):
    return V.value_assign(_pairs(spark, sf), 45.0)


def value_extra(spark, sf):
    p = _pairs(spark, sf)
    taken = p.where("part % 3 = 0").groupBy("doc", "page", "part").agg(F.min_by("value", F.struct("cost", "value")).alias("value"))
    return V.value_extra(p, taken, 16.0)


def value_home_fallback(spark, sf):
    """References and values whose places share a square of 60 stand for one symbol."""
    p = table(spark, sf, "parts")
    home = lambda x, y: (F.floor(x / 60) * 1000 + F.floor(y / 60)).cast("long")
    parts = p.where("i % 4 = 0").select("doc", "page", F.col("i").cast("long").alias("part"), home(F.col("x"), F.col("y")).alias("symbol"), "x", "y")
    values = p.where("value is not null").select("doc", "page", F.col("i").cast("long").alias("value"), home(F.col("x"), F.col("y")).alias("symbol"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return V.value_home_fallback(parts, values, 500.0)


SHEET = "doc * 5 + page AS doc"
_NONE = "CAST(NULL AS DOUBLE)"
_BASE = lambda power: f"""SELECT {SHEET}, 'wire' AS what, NULL AS name, NULL AS value, x1, y1, x2, y2 FROM segs UNION ALL SELECT {SHEET}, 'junction', NULL, NULL, x, y, NULL, NULL FROM dots UNION ALL SELECT {SHEET}, 'label', str, NULL, trunc(ax), trunc(ay), NULL, NULL FROM texts
UNION ALL SELECT {SHEET}, 'label', str, NULL, {power}, NULL, NULL FROM texts WHERE text_id % 7 = 0 UNION ALL SELECT {SHEET}, 'part', ref, value, NULL, NULL, NULL, NULL FROM parts"""  # noqa: E731
FX = ("segs", "dots", "texts", "parts")
_PX, _CURVE = "842 - 20 - ", "s.seg_id % 3 = 0"
_STRAIGHT = """SELECT doc, page, seg_id AS path_id, 0 AS sub, 0 AS k, x1 + 10 AS x1, 822 - y1 AS y1, x2 + 10 AS x2, 822 - y2 AS y2, true AS orth FROM segs UNION ALL SELECT doc, page, seg_id, 0, 2, x2 + 13, 818 - y2, x2 + 13, 813 - y2, true FROM segs
UNION ALL SELECT doc, page, seg_id, 1, 0, x1 + 10, 820 - y1, x1 + 15, 820 - y1, true FROM segs"""
_CLOSE = " UNION ALL SELECT doc, page, seg_id, 0, 3, x2 + 13, 813 - y2, x1 + 10, 822 - y1, false FROM segs WHERE seg_id % 3 = 0"
_PAIRS = f"{_P}, pp AS (SELECT doc, page, i AS part, vid AS value, cost FROM pairs)"

JOBS = {
    "src_kicad_legacy": (src_kicad_legacy, with_ctes(_BASE("trunc(ax), trunc(ay)"), *FX)),
    "src_kicad_sexpr": (src_kicad_sexpr, with_ctes(_BASE("trunc(ax) + 4, trunc(ay) - 3"), *FX)),
    "src_eagle_xml": (src_eagle_xml, with_ctes(f"""SELECT {SHEET}, 'wire' AS what, NULL AS name, NULL AS value, x1, y1, x2, y2 FROM segs WHERE seg_id % 9 <> 4 UNION ALL SELECT {SHEET}, 'label', CASE WHEN floor(seg_id / 4) % 3 = 0 THEN 'N$' ELSE 'A&B' END || CAST(CAST(floor(seg_id / 4) AS BIGINT) AS STRING), NULL, x1, y1, NULL, NULL FROM segs WHERE seg_id % 6 = 0
UNION ALL SELECT {SHEET}, 'part', ref, NULL, NULL, NULL, NULL, NULL FROM parts""", "segs", "parts")),
    "src_dispatch": (src_dispatch, with_ctes("d AS (SELECT DISTINCT doc * 5 + page AS doc FROM segs) SELECT doc, 's' || doc || CASE doc % 3 WHEN 1 THEN '.KICAD_SCH' ELSE '.sch' END AS name, CASE doc % 3 WHEN 0 THEN 'legacy' WHEN 1 THEN 'sexpr' ELSE 'eagle' END AS reader FROM d UNION ALL SELECT doc, 'x.pdf', 'error' FROM d", "segs")),
    "manifest_filter": (manifest_filter, with_ctes("e AS (SELECT 'sheet-' || lower(ref) || '-' || doc || '-' || page AS id, ref, i FROM parts) SELECT id, CASE WHEN i % 4 = 0 THEN 'dir/a.b/' || ref || '.pdf' ELSE 'corpus/files/' || id || '.pdf' END AS pdf_path, CASE WHEN i % 3 > 0 THEN 'corpus/files/' || id || '.kicad_sch' END AS source_path FROM e WHERE contains(id, '-r') OR contains(id, 'u1')", "parts")),
    "gt_connect": (gt_connect, with_ctes(f"""{O.ENDS}, {O.SHARED}, hits AS (SELECT d.doc, d.page, d.x, d.y, s.seg_id FROM dots d JOIN segs s ON d.doc = s.doc AND d.page = s.page AND {dist('d.x', 'd.y', 's.x1', 's.y1', 's.x2', 's.y2')} <= 0.15), {O.THROUGH},
lab AS (SELECT l.doc, l.page, 'n' || l.seg_id % 40 AS name, min(s.seg_id) AS seg_id FROM segs l JOIN segs s ON l.doc = s.doc AND l.page = s.page AND l.seg_id % 5 = 0 AND {dist('l.x1', 'l.y1', 's.x1', 's.y1', 's.x2', 's.y2')} <= 0.15 GROUP BY l.doc, l.page, l.seg_id),
e6 AS (SELECT DISTINCT l.doc, l.page, m.src, l.seg_id AS dst FROM lab l JOIN (SELECT doc, page, name, min(seg_id) AS src FROM lab GROUP BY doc, page, name) m ON l.doc = m.doc AND l.page = m.page AND l.name = m.name WHERE m.src <> l.seg_id),
every AS (SELECT * FROM e1 UNION SELECT * FROM e4 UNION SELECT * FROM e6), {O.components('every')}, num AS (SELECT doc, page, seg_id, dense_rank() OVER (PARTITION BY doc, page ORDER BY root) - 1 AS net_id FROM cc)
SELECT n.doc, n.page, n.net_id, n.n, a.names FROM (SELECT doc, page, net_id, count(*) AS n FROM num GROUP BY doc, page, net_id) n LEFT JOIN (SELECT doc, page, net_id, array_to_string(list_sort(list(DISTINCT name)), ',') AS names FROM lab JOIN num USING (doc, page, seg_id) GROUP BY doc, page, net_id) a ON n.doc = a.doc AND n.page = a.page AND n.net_id = a.net_id""", "segs", "dots")),
    "fit_transform": (fit_transform, with_ctes("SELECT doc, page, 2.0 AS a, 0.0 AS b, 0.0 AS c, 2.0 AS d, 40.0 AS e, -30.0 AS f, 2 * count(*) AS inliers, 2 * count(*) AS total FROM segs GROUP BY doc, page", "segs")),
    "fit_gate": (fit_gate, with_ctes("f AS (SELECT doc, page, count(*) FILTER (pred = 1) * CASE WHEN page % 2 = 0 THEN 3 ELSE 1 END / count(*) AS share FROM pins GROUP BY doc, page) SELECT doc, page, round(share, 6) AS share, share > 0.3 AS ok FROM f", "pins")),
    "decode_path": (decode_path, with_ctes(f"SELECT * FROM ({_STRAIGHT}{_CLOSE}) z", "segs")),
    "raw_orth_segs": (raw_orth_segs, with_ctes(f"SELECT doc, page, path_id, sub, k, x1, y1, x2, y2 FROM ({_STRAIGHT}) z WHERE path_id % 4 <> 1", "segs")),
    "junction_dots": (junction_dots, with_ctes("SELECT doc, page, sym_id AS prim_id, x0 + 2 AS x, y0 + 2 AS y, 2.0 AS r FROM marks WHERE sym_id % 4 = 2 AND sym_id % 3 <> 0 AND sym_id % 5 <> 0", "marks")),
    "closed_triangles": (closed_triangles, with_ctes("SELECT doc, page, sym_id AS prim_id, x0, y0, x0 + 4 AS x1, y0 + 3 AS y1 FROM marks WHERE sym_id % 4 = 1", "marks")),
    "route_prims": (route_prims, with_ctes("""SELECT doc, page, sym_id AS prim_id, NOT fill AND w AS wire, NOT fill AND k < 3 AND NOT w AS body, k < 3 AS symbol, NOT fill AND k = 3 AND NOT w AS pin_line, NOT fill AND k = 3 AS bar
FROM (SELECT *, sym_id % 4 AS k, sym_id % 3 <> 0 AS fill, sym_id % 2 = 1 AS w FROM marks WHERE sym_id % 5 <> 0) z""", "marks")),
    "mono_variant": (mono_variant, with_ctes("s AS (SELECT doc, page, color AS stroke, CASE prim_id % 3 WHEN 0 THEN '#FEFEFE' WHEN 1 THEN color END AS fill FROM strokes), b AS (SELECT *, 'colour' AS scenario FROM s UNION ALL SELECT doc, page, '#000000', CASE WHEN lower(fill[2:2]) IN ('e', 'f') THEN fill ELSE '#000000' END, 'mono' FROM s) SELECT doc, page, scenario, stroke, fill, count(*) AS n FROM b GROUP BY ALL", "strokes")),
    "value_assign": (value_assign, None),
    "value_home_fallback": (value_home_fallback, None),
    "value_extra": (value_extra, with_ctes(f"""{_PAIRS}, taken AS (SELECT doc, page, part, value FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, part ORDER BY cost, value) AS r FROM pp WHERE part % 3 = 0) z WHERE r = 1),
free AS (SELECT * FROM pp p WHERE cost < 16 AND part % 3 = 0 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc = p.doc AND t.page = p.page AND t.value = p.value)), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, part ORDER BY cost, value) AS r FROM free) z WHERE r = 1)
SELECT doc, page, part, value FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, value ORDER BY cost, part) AS q FROM n) z WHERE q = 1""", "parts")),
}
