"""Queries on labels, pins, links and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import symbols as S
from ..sources.fixtures import table, tables, with_ctes
from . import oracle as O
from .oracle import dist, gap, power

PAGE = "t.doc = s.doc AND t.page = s.page"
_B = lambda a: tuple(f"{a}.{c}" for c in ("x0", "y0", "x1", "y1"))
_SEG = ("least(s.x1, s.x2)", "least(s.y1, s.y2)", "greatest(s.x1, s.x2)", "greatest(s.y1, s.y2)")
COS = f"abs(CASE WHEN {O._LEVEL} THEN s.x2 - s.x1 ELSE s.y2 - s.y1 END) / greatest(sqrt((s.x2-s.x1)*(s.x2-s.x1)+(s.y2-s.y1)*(s.y2-s.y1)), 0.000001)"
_PU = f"SELECT t.doc, t.page, t.text_id, round(max((least({O._HI}, {O._LEN}) - greatest({O._LO}, 0)) / {O._LEN}), 6) AS cover FROM {{}} t JOIN segs s ON {PAGE} AND {COS} >= 0.97 AND {O._OFF} >= t.size * -0.7 AND {O._OFF} <= t.size * 0.3 AND least({O._HI}, {O._LEN}) > greatest({O._LO}, 0) GROUP BY t.doc, t.page, t.text_id"
_PICK = lambda a, b: f"(CASE WHEN t.rot = 0 THEN {a} ELSE {b} END)"
_A0, _A1, _P0, _P1 = _PICK("t.x0", "t.y0"), _PICK("t.x1", "t.y1"), f"least({_PICK('s.x1', 's.y1')}, {_PICK('s.x2', 's.y2')})", f"greatest({_PICK('s.x1', 's.y1')}, {_PICK('s.x2', 's.y2')})"
_PE = f"""SELECT DISTINCT t.doc, t.page, t.text_id FROM {{}} t JOIN segs s ON {PAGE} AND abs({_PICK('s.y1 - s.y2', 's.x1 - s.x2')}) <= 0.02 AND {_PICK('s.y1', 's.x1')} BETWEEN {_PICK('t.y0', 't.x0')} + t.size * 0.15 AND {_PICK('t.y1', 't.x1')} - t.size * 0.15
AND CASE WHEN {_P1} <= {_A0} + t.size * 0.2 THEN {_A0} - {_P1} WHEN {_P0} >= {_A1} - t.size * 0.2 THEN {_P0} - {_A1} END <= t.size * 1.1"""
_GLYPH = "glyph AS (SELECT p.doc, p.page, p.prim_id, min(t.text_id) AS text_id FROM strokes p JOIN texts t ON p.doc = t.doc AND p.page = t.page AND greatest(p.x1 - p.x0, p.y1 - p.y0) <= t.size * 1.6 AND p.x0 >= t.x0 - 0.45 * t.size AND p.x1 <= t.x1 + 0.45 * t.size AND p.y0 >= t.y0 - 0.45 * t.size AND p.y1 <= t.y1 + 0.45 * t.size AND (p.x0 + p.x1) / 2 BETWEEN t.x0 - t.size AND t.x1 + t.size GROUP BY p.doc, p.page, p.prim_id)"
_SHARE = lambda lo, hi: f"greatest(0, least(t.{hi}, s.{hi}) - greatest(t.{lo}, s.{lo})) / greatest(0.000001, least(t.{hi} - t.{lo}, s.{hi} - s.{lo}))"
_NEED = f"CASE WHEN {power('t.str')} THEN 0.35 ELSE 0.5 END"
_CAND = f"""cand AS (SELECT * FROM (SELECT t.doc, t.page, t.text_id, s.sym_id, {gap(_B('t'), _B('s'))} AS gap, row_number() OVER (PARTITION BY t.doc, t.page, t.text_id ORDER BY {gap(_B('t'), _B('s'))}, s.sym_id) AS r FROM texts t JOIN marks s ON {PAGE} AND {gap(_B('t'), _B('s'))} <= t.size * 1.6
AND ({_SHARE('x0', 'x1')} >= {_NEED} OR {_SHARE('y0', 'y1')} >= {_NEED}) WHERE NOT EXISTS (SELECT 1 FROM texts o WHERE o.doc = s.doc AND o.page = s.page AND o.text_id <> t.text_id AND (o.x0 + o.x1) / 2 > s.x0 AND (o.x0 + o.x1) / 2 < s.x1 AND (o.y0 + o.y1) / 2 > s.y0 AND (o.y0 + o.y1) / 2 < s.y1)) z WHERE r <= 3)"""
_IN = lambda e: f"(s.x{e} BETWEEN m.x0 - 0.6 AND m.x1 + 0.6 AND s.y{e} BETWEEN m.y0 - 0.6 AND m.y1 + 0.6)"
_MX, _MY = "(m.x0 + m.x1) / 2", "(m.y0 + m.y1) / 2"
_ENDS = f"""ends1 AS (SELECT m.doc, m.page, m.sym_id, s.seg_id, round(sqrt(power(CASE WHEN {_IN(1)} THEN s.x1 ELSE s.x2 END - {_MX}, 2) + power(CASE WHEN {_IN(1)} THEN s.y1 ELSE s.y2 END - {_MY}, 2)), 6) AS d FROM marks m JOIN segs s ON m.doc = s.doc AND m.page = s.page AND {_IN(1)} <> {_IN(2)}),
ends2 AS (SELECT doc, page, sym_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, sym_id ORDER BY d, seg_id) AS r FROM ends1) z WHERE r = 1)"""
_H = lambda x, y: f"sqrt(({x} - (t.x0 + t.x1) / 2) * ({x} - (t.x0 + t.x1) / 2) + ({y} - (t.y0 + t.y1) / 2) * ({y} - (t.y0 + t.y1) / 2))"
_NEAR = lambda a, reach, keep: f"(SELECT doc, page, text_id, seg_id FROM (SELECT t.doc, t.page, t.text_id, s.seg_id, {gap(_B('t'), _SEG)} AS d, {reach} AS reach, row_number() OVER (PARTITION BY t.doc, t.page, t.text_id ORDER BY {gap(_B('t'), _SEG)}, s.seg_id) AS r FROM {a} t JOIN segs s ON {PAGE} WHERE {keep}) z WHERE r = 1 AND d <= reach)"
_BARE = "regexp_matches(t.str, '(?i)^[0-9]+([.,][0-9]+)?V[0-9]*$')"
_ATTACH = f"""{O.LABELS}, {_CAND}, {_ENDS}, rules AS (SELECT t.doc, t.page, t.text_id, t.seg_id, 1 AS rule, 'along' AS via, true AS port FROM labels0 t WHERE NOT {_BARE} UNION ALL SELECT *, 2, 'flag', true FROM {_NEAR('flags', '0.6', 'true')}
UNION ALL SELECT c.doc, c.page, c.text_id, arg_min(s.seg_id, c.r), 3, 'symbol', true FROM cand c JOIN ends2 e ON c.doc = e.doc AND c.page = e.page AND c.sym_id = e.sym_id JOIN segs s ON s.doc = e.doc AND s.page = e.page AND s.seg_id = e.seg_id JOIN texts t ON t.doc = c.doc AND t.page = c.page AND t.text_id = c.text_id JOIN marks m ON m.doc = c.doc AND m.page = c.page AND m.sym_id = c.sym_id
 WHERE least({_H('s.x1', 's.y1')}, {_H('s.x2', 's.y2')}) + 0.1 >= {_H(_MX, _MY)} GROUP BY c.doc, c.page, c.text_id UNION ALL SELECT *, 4, 'near', false FROM {_NEAR('texts', 'greatest(0.6, t.size * 0.4)', f'NOT {_BARE}')}),
attached AS (SELECT doc, page, text_id, seg_id, via, port FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY rule) AS r FROM rules) z WHERE r = 1)"""


def _t(*names):
    return lambda spark, sf: tables(spark, sf, *names)


def pin_under_text(spark, sf):
    return L.pin_under_text(*_t("texts", "segs")(spark, sf))


def pin_end_in_line(spark, sf):
    return L.pin_end_in_line(*_t("fields", "segs")(spark, sf))


def glyph_under(spark, sf):
    return L.glyph_under(*_t("strokes", "texts")(spark, sf))


def pen_of_text(spark, sf):
    return L.pen_of_text(*_t("strokes", "texts")(spark, sf))


def symbol_candidates(spark, sf):
    return L.symbol_candidates(*_t("texts", "marks")(spark, sf))


def attach_labels(spark, sf):
    return L.attach_labels(*_t("texts", "segs", "marks", "flags")(spark, sf))


def link_best_text(spark, sf):
    return L.link_best_text(*_t("links", "texts")(spark, sf))


def wire_in_link_filter(spark, sf):
    s, f = _t("segs", "flags")(spark, sf)
    big = f.select("doc", "page", *[(F.col(c) + (12 if c[1] == "1" else -12)).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return L.wire_in_link_filter(s, big).select("doc", "page", "seg_id")


def marker_refs(spark, sf):
    f, p = _t("fields", "parts")(spark, sf)
    return L.marker_refs(f, p.where("i % 3 = 1 and page <> 2").select("doc", "page", "ref")).select("doc", "page", "text_id", "kind")


def loose_refs(spark, sf):
    return L.loose_refs(table(spark, sf, "fields"))


def pin_like_refs(spark, sf):
    return L.pin_like_refs(*_t("fields", "segs")(spark, sf))


def ground_label_attach(spark, sf):
    t, s = _t("texts", "segs")(spark, sf)
    return L.ground_label_attach(t, s.where("seg_id % 4 = 2"), 12.5)


def _boxes(spark, sf):
    return table(spark, sf, "marks").withColumnRenamed("sym_id", "box_id").withColumn("x1", F.col("x1") + 7)


BOXES = "boxes AS (SELECT doc, page, sym_id AS box_id, x0, y0, x1 + 7 AS x1, y1 FROM marks), touch AS (SELECT a.doc, a.page, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.doc = b.doc AND a.page = b.page AND a.box_id <> b.box_id AND b.x0 <= a.x1 + 0.25 AND b.x1 >= a.x0 - 0.25 AND b.y0 <= a.y1 + 0.25 AND b.y1 >= a.y0 - 0.25), reach(doc, page, node, root) AS (SELECT doc, page, box_id, box_id FROM boxes UNION SELECT t.doc, t.page, t.b, r.root FROM reach r JOIN touch t ON r.doc = t.doc AND r.page = t.page AND r.node = t.a), glued AS (SELECT doc, page, node AS box_id, min(root) AS symbol FROM reach GROUP BY doc, page, node)"


def glue_symbols(spark, sf):
    b = _boxes(spark, sf).persist()
    return S.symbol_boxes(b, S.glue_symbols(b, 0.25), 30.0)


def part_symbols(spark, sf):
    b = _boxes(spark, sf).persist()
    return S.home_symbol(table(spark, sf, "fields"), b, S.glue_symbols(b, 0.25), 20.0)


def _gaps(spark, sf):
    t = table(spark, sf, "fields")
    a, b = (t.where(f"kind = '{k}'").select("doc", "page", F.col("text_id").alias(n), *[F.col(c).alias(n + c) for c in ("x0", "y0", "x1", "y1")]) for n, k in (("a", "component"), ("b", "value")))
    return a.withColumn("b", F.col("a") + 1).join(b, ["doc", "page", "b"])


def symbol_between(spark, sf):
    b = table(spark, sf, "marks").select("doc", "page", "x0", "y0", (F.col("x1") + 12).alias("x1"), (F.col("y1") + 12).alias("y1"))
    return S.symbol_between(_gaps(spark, sf), b)


def cut_at_triangles(spark, sf):
    return S.cut_at_triangles(*_t("segs", "marks")(spark, sf))


def prune_islands(spark, sf):
    s, d = _t("segs", "dots")(spark, sf)
    wires = s.withColumn("net_id", F.floor(F.col("seg_id") / 2))
    named = wires.where("net_id % 7 = 0").select("doc", "page", "net_id").distinct()
    return S.prune_islands(wires, d, named, 70.0).select("doc", "page", "seg_id", "net_id")


_WIDE = "greatest(a.x0, b.x0) > least(a.x1, b.x1)"
_CUT = f"(CASE WHEN s.y1 = s.y2 THEN s.y1 > m.y0 + 0.05 AND s.y1 < m.y1 - 0.05 AND s.x1 < m.x0 - 0.05 AND s.x2 > m.x1 + 0.05 ELSE s.x1 > m.x0 + 0.05 AND s.x1 < m.x1 - 0.05 AND s.y1 < m.y0 - 0.05 AND s.y2 > m.y1 + 0.05 END)"

JOBS = {
    "pin_under_text": (pin_under_text, with_ctes(_PU.format("texts"), "texts")),
    "pin_end_in_line": (pin_end_in_line, with_ctes(_PE.format("fields"), "segs", "fields")),
    "glyph_under": (glyph_under, with_ctes(f"{_GLYPH} SELECT * FROM glyph", "strokes")),
    "pen_of_text": (pen_of_text, with_ctes(f"""{_GLYPH}, n AS (SELECT g.doc, g.page, g.text_id, p.color, count(*) AS n FROM glyph g JOIN strokes p ON g.doc = p.doc AND g.page = p.page AND g.prim_id = p.prim_id JOIN texts t ON t.doc = g.doc AND t.page = g.page AND t.text_id = g.text_id AND p.x0 >= t.x0 - 0.12 * t.size AND p.x1 <= t.x1 + 0.12 * t.size AND p.y0 >= t.y0 - 0.12 * t.size AND p.y1 <= t.y1 + 0.12 * t.size GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nx FROM n WINDOW w AS (PARTITION BY doc, page, text_id ORDER BY n DESC, color)) SELECT doc, page, text_id, color FROM o WHERE r = 1 AND (nx IS NULL OR n >= nx * 2)""", "strokes")),
    "symbol_candidates": (symbol_candidates, with_ctes(f"{_CAND} SELECT doc, page, text_id, sym_id, round(gap, 6) AS gap, r FROM cand", "texts", "marks")),
    "attach_labels": (attach_labels, with_ctes(f"{_ATTACH} SELECT * FROM attached", "texts", "marks", "flags")),
    "link_best_text": (link_best_text, with_ctes("c AS (SELECT l.doc, l.page, l.link_id, t.text_id, greatest(0, least(t.x1, l.x1) - greatest(t.x0, l.x0)) * greatest(0, least(t.y1, l.y1) - greatest(t.y0, l.y0)) AS a FROM links l JOIN texts t ON l.doc = t.doc AND l.page = t.page AND (t.x0 + t.x1) / 2 BETWEEN l.x0 - 0.3 * t.size AND l.x1 + 0.3 * t.size AND (t.y0 + t.y1) / 2 BETWEEN l.y0 - 0.3 * t.size AND l.y1 + 0.3 * t.size) SELECT doc, page, link_id, text_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, link_id ORDER BY a DESC, text_id) AS r FROM c WHERE a > 0) z WHERE r = 1", "links")),
    "wire_in_link_filter": (wire_in_link_filter, with_ctes("f AS (SELECT doc, page, x0 - 12 AS x0, y0 - 12 AS y0, x1 + 12 AS x1, y1 + 12 AS y1 FROM flags) SELECT s.doc, s.page, s.seg_id FROM segs s WHERE NOT (EXISTS (SELECT 1 FROM f WHERE f.doc = s.doc AND f.page = s.page AND s.x1 > f.x0 AND s.x1 < f.x1 AND s.y1 > f.y0 AND s.y1 < f.y1) AND EXISTS (SELECT 1 FROM f WHERE f.doc = s.doc AND f.page = s.page AND s.x2 > f.x0 AND s.x2 < f.x1 AND s.y2 > f.y0 AND s.y2 < f.y1))", "flags")),
    "marker_refs": (marker_refs, with_ctes("m AS (SELECT DISTINCT doc, page, ref FROM parts WHERE i % 3 = 1 AND page <> 2) SELECT f.doc, f.page, f.text_id, CASE WHEN m.ref IS NOT NULL THEN 'component' WHEN f.page <> 2 AND f.kind = 'component' AND regexp_matches(f.str, '^[A-Z]+[0-9]+$') AND NOT f.in_body THEN CASE WHEN f.net_id IS NULL THEN 'note' ELSE 'net' END ELSE f.kind END AS kind FROM fields f LEFT JOIN m ON f.doc = m.doc AND f.page = m.page AND f.str = m.ref", "fields")),
    "loose_refs": (loose_refs, with_ctes("SELECT DISTINCT a.doc, a.page, a.text_id FROM fields a JOIN fields b ON a.doc = b.doc AND a.page = b.page AND a.kind = 'net' AND a.net_id IS NULL AND regexp_matches(a.str, '^[A-Z][A-Z0-9_-]{1,14}[0-9]{1,3}[A-Z]?$') AND b.kind = 'value' AND b.x0 <= a.x1 + 15 AND b.x1 >= a.x0 - 15 AND b.y0 <= a.y1 + 12.5 AND b.y1 >= a.y0 - 12.5", "fields")),
    "pin_like_refs": (pin_like_refs, with_ctes(f"comp AS (SELECT * FROM fields WHERE kind = 'component'), body AS (SELECT * FROM comp WHERE in_body), pu AS ({_PU.format('comp')}), pe AS ({_PE.format('body')}), tw AS (SELECT doc, page, str FROM comp GROUP BY doc, page, str HAVING count(*) >= 2) SELECT c.doc, c.page, c.text_id FROM comp c JOIN pu ON pu.doc = c.doc AND pu.page = c.page AND pu.text_id = c.text_id AND pu.cover > 0.5 JOIN tw ON tw.doc = c.doc AND tw.page = c.page AND tw.str = c.str UNION SELECT * FROM pe", "segs", "fields")),
    "ground_label_attach": (ground_label_attach, with_ctes(f"c AS (SELECT t.doc, t.page, t.text_id, s.seg_id, {gap(_B('t'), _SEG)} AS d FROM texts t JOIN segs s ON {PAGE} AND s.seg_id % 4 = 2 AND upper(t.str) LIKE '%GND%') SELECT doc, page, text_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY d, seg_id) AS r FROM c WHERE d < 12.5) z WHERE r = 1", "texts")),
    "glue_symbols": (glue_symbols, with_ctes(f"{BOXES}, u AS (SELECT b.doc, b.page, g.symbol, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes b JOIN glued g ON b.doc = g.doc AND b.page = g.page AND b.box_id = g.box_id GROUP BY b.doc, b.page, g.symbol) SELECT * FROM u WHERE greatest(x1 - x0, y1 - y0) < 30", "marks")),
    "part_symbols": (part_symbols, with_ctes(f"{BOXES}, c AS (SELECT t.doc, t.page, t.text_id, s.box_id, {gap(_B('t'), _B('s'))} AS d FROM fields t JOIN boxes s ON {PAGE} WHERE t.kind NOT IN ('pin', 'note')), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY d, box_id) AS r FROM c WHERE d < 20) z WHERE r = 1) SELECT n.doc, n.page, n.text_id, g.symbol FROM n JOIN glued g ON n.doc = g.doc AND n.page = g.page AND n.box_id = g.box_id", "marks", "fields")),
    "symbol_between": (symbol_between, with_ctes(f"""m AS (SELECT doc, page, x0, y0, x1 + 12 AS x1, y1 + 12 AS y1 FROM marks), s AS (SELECT a.doc, a.page, a.text_id AS a, b.text_id AS b, CASE WHEN {_WIDE} THEN least(a.x1, b.x1) ELSE greatest(a.x0, b.x0) END AS x0, CASE WHEN {_WIDE} THEN greatest(a.x0, b.x0) ELSE least(a.x1, b.x1) END AS x1,
CASE WHEN {_WIDE} THEN greatest(a.y0, b.y0) ELSE least(a.y1, b.y1) END AS y0, CASE WHEN {_WIDE} THEN least(a.y1, b.y1) ELSE greatest(a.y0, b.y0) END AS y1 FROM fields a JOIN fields b ON a.doc = b.doc AND a.page = b.page AND b.text_id = a.text_id + 1 AND a.kind = 'component' AND b.kind = 'value')
SELECT DISTINCT s.doc, s.page, s.a, s.b FROM s JOIN m ON s.doc = m.doc AND s.page = m.page AND s.x1 > s.x0 AND s.y1 > s.y0 AND m.x0 < s.x1 AND m.x1 > s.x0 AND m.y0 < s.y1 AND m.y1 > s.y0""", "marks", "fields")),
    "cut_at_triangles": (cut_at_triangles, with_ctes(f"""cuts AS (SELECT s.doc, s.page, s.seg_id, s.y1 = s.y2 AS level, CASE WHEN s.y1 = s.y2 THEN s.y1 ELSE s.x1 END AS across, CASE WHEN s.y1 = s.y2 THEN s.x1 ELSE s.y1 END AS lo, CASE WHEN s.y1 = s.y2 THEN s.x2 ELSE s.y2 END AS hi, CASE WHEN s.y1 = s.y2 THEN m.x0 ELSE m.y0 END AS a, CASE WHEN s.y1 = s.y2 THEN m.x1 ELSE m.y1 END AS z FROM segs s JOIN marks m ON s.doc = m.doc AND s.page = m.page AND {_CUT}),
apart AS (SELECT DISTINCT * FROM cuts), b AS (SELECT *, row_number() OVER (PARTITION BY doc, page, seg_id ORDER BY a) AS i, count(*) OVER (PARTITION BY doc, page, seg_id) AS n, lead(a) OVER (PARTITION BY doc, page, seg_id ORDER BY a) AS nx FROM apart),
p AS (SELECT doc, page, seg_id, 0 AS piece, level, across, lo AS a, a AS z FROM b WHERE i = 1 UNION ALL SELECT doc, page, seg_id, i, level, across, z, coalesce(nx, hi) FROM b),
o AS (SELECT doc, page, seg_id, CAST(piece AS INTEGER) AS piece, CASE WHEN level THEN a ELSE across END AS x1, CASE WHEN level THEN across ELSE a END AS y1, CASE WHEN level THEN z ELSE across END AS x2, CASE WHEN level THEN across ELSE z END AS y2 FROM p UNION ALL SELECT doc, page, seg_id, 0, x1, y1, x2, y2 FROM segs s WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.doc = s.doc AND c.page = s.page AND c.seg_id = s.seg_id))
SELECT * FROM o""", "segs", "marks")),
    "prune_islands": (prune_islands, with_ctes(f"""w AS (SELECT *, CAST(floor(seg_id / 2) AS BIGINT) AS net_id FROM segs), b AS (SELECT doc, page, net_id, min(seg_id) AS f, greatest(max(x2) - min(x1), max(y2) - min(y1)) AS d FROM w GROUP BY doc, page, net_id),
k AS (SELECT doc, page, net_id FROM b WHERE d >= 70 OR net_id % 7 = 0 UNION SELECT s.doc, s.page, s.net_id FROM dots d JOIN w s ON d.doc = s.doc AND d.page = s.page AND {dist('d.x', 'd.y', 's.x1', 's.y1', 's.x2', 's.y2')} <= greatest(d.r, 0.15)),
n AS (SELECT b.doc, b.page, b.net_id, row_number() OVER (PARTITION BY b.doc, b.page ORDER BY b.f) - 1 AS new_id FROM b JOIN k ON b.doc = k.doc AND b.page = k.page AND b.net_id = k.net_id)
SELECT w.doc, w.page, w.seg_id, n.new_id AS net_id FROM w JOIN n ON w.doc = n.doc AND w.page = n.page AND w.net_id = n.net_id""", "segs", "dots")),
}
