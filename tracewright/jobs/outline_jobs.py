"""Queries on outlines that are drawn as loose strokes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlines as B
from ..sources.fixtures import table, tables, with_ctes


def _t(spark, sf, *names):
    return tables(spark, sf, *names)


def port_outlines(spark, sf):
    return B.port_outlines(*_t(spark, sf, "diags", "edges", "heights"))[0].drop("port")


def port_strokes(spark, sf):
    """The strokes that ports claim."""
    return B.port_outlines(*_t(spark, sf, "diags", "edges", "heights"))[1]


def symbols_outside_ports(spark, sf):
    ports, _ = B.port_outlines(*_t(spark, sf, "diags", "edges", "heights"))
    return B.symbols_outside(*_t(spark, sf, "marks"), ports, *_t(spark, sf, "heights"))


def rect_from_lines(spark, sf):
    return B.rect_from_lines(*_t(spark, sf, "frames", "heights"))[0]


def rect_lines_used(spark, sf):
    return B.rect_from_lines(*_t(spark, sf, "frames", "heights"))[1]


def _links(spark, sf):
    p = table(spark, sf, "parts").where("i % 9 = 0")
    return p.select("doc", "page", (F.col("x") - 40).alias("x0"), (F.col("y") - 40).alias("y0"), (F.col("x") + 60).alias("x1"), (F.col("y") + 60).alias("y1"))


def rect_from_wires(spark, sf):
    wires, texts, heights = _t(spark, sf, "frames", "fields", "heights")
    return B.rect_from_wires(wires, texts.where("text_id % 3 = 0"), _links(spark, sf), heights)[0]


_MEET = lambda a, b, x="x", y="y": f"{a}.doc = {b}.doc AND {a}.page = {b}.page AND abs(floor({b}.x / tol + 0.5) - floor({a}.{x} / tol + 0.5)) <= 1 AND abs(floor({b}.y / tol + 0.5) - floor({a}.{y} / tol + 0.5)) <= 1"
_CLOSE = lambda a, b, x="x", y="y": f"{_MEET(a, b, x, y)} AND sqrt(power({b}.x - {a}.{x}, 2) + power({b}.y - {a}.{y}, 2)) <= 1.5 * tol"
#: CTEs up to accepted(doc, page, vi, vj, ..., box), tol 0.2 and height 5 as in the fixtures.
_PORTS = f"""
de AS MATERIALIZED (SELECT doc, page, diag_id, diag_id * 2 AS v, x1 AS x, y1 AS y, x2 AS fx, y2 AS fy FROM diags UNION ALL SELECT doc, page, diag_id, diag_id * 2 + 1, x2, y2, x1, y1 FROM diags),
se AS MATERIALIZED (SELECT doc, page, seg_id, x1 AS x, y1 AS y, x2 AS fx, y2 AS fy, glyph FROM edges UNION ALL SELECT doc, page, seg_id, x2, y2, x1, y1, glyph FROM edges),
tips AS MATERIALIZED (SELECT *, CASE WHEN upright THEN sign(ax - tx) ELSE 0 END AS ux, CASE WHEN upright THEN 0 ELSE sign(ay - ty) END AS uy FROM (
  SELECT a.doc, a.page, a.v AS vi, b.v AS vj, a.x AS tx, a.y AS ty, a.fx AS ax, a.fy AS ay, b.fx AS bx, b.fy AS bz, abs(a.fx - b.fx) < 0.2 AS upright FROM de a JOIN de b ON a.v < b.v AND a.diag_id <> b.diag_id AND {_CLOSE('a', 'b').replace('tol', '0.2')}
  WHERE (abs(a.fx - b.fx) < 0.2) <> (abs(a.fy - b.fy) < 0.2) AND sqrt(power(a.fx - b.fx, 2) + power(a.fy - b.fy, 2)) BETWEEN 2 AND 17.5 AND abs(sqrt(power(a.fx - a.x, 2) + power(a.fy - a.y, 2)) - sqrt(power(b.fx - a.x, 2) + power(b.fy - a.y, 2))) <= 0.4) z
  WHERE CASE WHEN upright THEN ax <> tx ELSE ay <> ty END),
base AS (SELECT *, 'a' AS side, ax AS px, ay AS py FROM tips UNION ALL SELECT *, 'b', bx, bz FROM tips),
sides AS MATERIALIZED (SELECT * FROM (SELECT t.*, s.seg_id, s.fx, s.fy, (s.fx - t.px) * t.ux + (s.fy - t.py) * t.uy AS len, abs((s.fx - t.px) * t.uy - (s.fy - t.py) * t.ux) AS off FROM base t JOIN se s ON {_CLOSE('t', 's', 'px', 'py').replace('tol', '0.2')}) z WHERE len > 2.5 AND len < 150 AND off < 0.2),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, a.doc, a.page, a.vi, a.vj, a.upright, a.tx, a.ty, a.ax, a.ay, a.bx, a.bz, a.seg_id AS m, b.seg_id AS n, a.fx AS afx, a.fy AS afy, b.fx AS bfx, b.fy AS bfy, CASE WHEN a.upright THEN a.fx ELSE a.fy END AS line,
  CASE WHEN a.upright THEN least(a.fy, b.fy) ELSE least(a.fx, b.fx) END AS lo, CASE WHEN a.upright THEN greatest(a.fy, b.fy) ELSE greatest(a.fx, b.fx) END AS hi
  FROM sides a JOIN sides b ON a.doc = b.doc AND a.page = b.page AND a.vi = b.vi AND a.vj = b.vj AND a.side = 'a' AND b.side = 'b' AND a.seg_id <> b.seg_id AND abs(a.len - b.len) <= greatest(0.4, a.len * 0.06)),
far AS (SELECT *, 'a' AS side, afx AS px, afy AS py FROM pairs UNION ALL SELECT *, 'b', bfx, bfy FROM pairs),
back AS MATERIALIZED (SELECT DISTINCT f.id, s.seg_id, abs(CASE WHEN f.upright THEN s.fy - s.y ELSE s.fx - s.x END) AS len FROM far f JOIN se s ON {_MEET('f', 's', 'px', 'py').replace('tol', '0.2')} AND s.seg_id <> f.m AND s.seg_id <> f.n
  AND abs(CASE WHEN f.upright THEN s.x ELSE s.y END - f.line) <= 0.2 AND abs(CASE WHEN f.upright THEN s.fx ELSE s.fy END - f.line) <= 0.2 AND least(CASE WHEN f.upright THEN s.y ELSE s.x END, CASE WHEN f.upright THEN s.fy ELSE s.fx END) >= f.lo - 0.2 AND greatest(CASE WHEN f.upright THEN s.y ELSE s.x END, CASE WHEN f.upright THEN s.fy ELSE s.fx END) <= f.hi + 0.2),
drawn AS (SELECT id, sum(len) AS d FROM back GROUP BY id),
lettered AS (SELECT id, sum(o) AS d FROM (SELECT p.id, least(CASE WHEN p.upright THEN greatest(s.y1, s.y2) ELSE greatest(s.x1, s.x2) END, p.hi) - greatest(CASE WHEN p.upright THEN least(s.y1, s.y2) ELSE least(s.x1, s.x2) END, p.lo) AS o
  FROM pairs p JOIN edges s ON s.doc = p.doc AND s.page = p.page AND s.glyph AND abs(CASE WHEN p.upright THEN s.x1 ELSE s.y1 END - p.line) <= 0.2 AND abs(CASE WHEN p.upright THEN s.x2 ELSE s.y2 END - p.line) <= 0.2) z WHERE o > 0 GROUP BY id),
tipped AS (SELECT id FROM far f JOIN de s ON {_CLOSE('f', 's', 'px', 'py').replace('tol', '0.2')} GROUP BY id HAVING count(DISTINCT side) = 2),
closed AS (SELECT p.* FROM pairs p LEFT JOIN drawn d USING (id) LEFT JOIN lettered l USING (id) LEFT JOIN tipped t USING (id) WHERE coalesce(d.d, 0) + CASE WHEN coalesce(d.d, 0) < (hi - lo) * 0.9 THEN coalesce(l.d, 0) ELSE 0 END >= (hi - lo) * 0.9 OR t.id IS NOT NULL),
accepted AS MATERIALIZED (SELECT *, least(tx, ax, bx, afx, bfx) AS x0, least(ty, ay, bz, afy, bfy) AS y0, greatest(tx, ax, bx, afx, bfx) AS x1, greatest(ty, ay, bz, afy, bfy) AS y1
  FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, least(m, n), greatest(m, n) ORDER BY vi, vj, m, n) AS r FROM closed) z WHERE r = 1),
found AS (SELECT DISTINCT doc, page, x0, y0, x1, y1 FROM accepted)"""
_TURN = f"""fe AS MATERIALIZED (SELECT doc, page, seg_id, 0 AS e, x1 AS x, y1 AS y, x2 AS fx, y2 AS fy FROM frames UNION ALL SELECT doc, page, seg_id, 1, x2, y2, x1, y1 FROM frames),
turn AS MATERIALIZED (SELECT a.doc, a.page, a.seg_id AS l, a.e AS e, abs(a.y - a.fy) < 0.02 AS level, b.seg_id AS o, 1 - b.e AS oe, b.fx, b.fy, [floor(b.x / 0.15 + 0.5) - floor(a.x / 0.15 + 0.5), floor(b.y / 0.15 + 0.5) - floor(a.y / 0.15 + 0.5), b.seg_id * 2 + b.e] AS k
  FROM fe a JOIN fe b ON a.seg_id <> b.seg_id AND (abs(a.y - a.fy) < 0.02) <> (abs(b.y - b.fy) < 0.02) AND {_CLOSE('a', 'b').replace('tol', '0.15')}),
walk AS MATERIALIZED (SELECT a.doc, a.page, a.l, b.l AS b, c.l AS c, c.o AS d, row_number() OVER (PARTITION BY a.doc, a.page, a.l ORDER BY a.k, b.k, c.k) AS r FROM turn a JOIN turn b ON a.doc = b.doc AND a.page = b.page AND a.level AND a.e = 1 AND a.o = b.l AND a.oe = b.e AND b.o <> a.l
  JOIN turn c ON c.doc = b.doc AND c.page = b.page AND b.o = c.l AND b.oe = c.e AND c.o <> b.l JOIN frames f ON f.doc = a.doc AND f.page = a.page AND f.seg_id = a.l AND sqrt(power(c.fx - f.x1, 2) + power(c.fy - f.y1, 2)) <= 0.225),
w AS MATERIALIZED (SELECT doc, page, l, b, c, d FROM walk WHERE r = 1)"""
#: Walks in order, each pair of level lines taken if the first is not taken yet, folded over a page.
_FIT = lambda w: f"fold AS (SELECT doc, page, list_reduce(list_prepend(CAST([] AS BIGINT[]), list([l, c] ORDER BY l, c)), lambda acc, p: CASE WHEN list_contains(list_slice(acc, 1, len(acc)), p[1]) AND NOT (len(acc) > 1 AND acc[len(acc) - 1] = p[1]) THEN acc ELSE acc || p END) AS t FROM {w} GROUP BY doc, page), kept AS (SELECT DISTINCT doc, page, unnest(list_transform(range(1, len(t), 2), lambda i: t[i])) AS l FROM fold)"
_LINES = f"{_TURN}, {_FIT('w')}, good AS (SELECT w.* FROM w JOIN kept USING (doc, page, l))"
_BOXES = "SELECT g.doc, g.page, g.l AS line, least(f.x1, f.x2) AS x0, least(f.y1, h.y1) AS y0, greatest(f.x1, f.x2) AS x1, greatest(f.y1, h.y1) AS y1 FROM good g JOIN frames f ON f.doc = g.doc AND f.page = g.page AND f.seg_id = g.l JOIN frames h ON h.doc = g.doc AND h.page = g.page AND h.seg_id = g.c"
_WIRES = f"""fe AS MATERIALIZED (SELECT doc, page, seg_id, e, x, y, fx, fy, floor(x * 10 + 0.5) AS kx, floor(y * 10 + 0.5) AS ky, floor(fx * 10 + 0.5) AS gx, floor(fy * 10 + 0.5) AS gy FROM (SELECT doc, page, seg_id, 0 AS e, x1 AS x, y1 AS y, x2 AS fx, y2 AS fy FROM frames UNION ALL SELECT doc, page, seg_id, 1, x2, y2, x1, y1 FROM frames) z),
lv AS (SELECT * FROM fe WHERE abs(y - fy) <= 0.02), up AS (SELECT * FROM fe WHERE abs(x - fx) <= 0.02),
walk AS MATERIALIZED (SELECT a.doc, a.page, a.seg_id AS l, c.seg_id AS c, least(a.fx, a.x) AS x0, least(a.fy, b.fy) AS y0, greatest(a.fx, a.x) AS x1, greatest(a.fy, b.fy) AS y1 FROM lv a JOIN up b ON a.e = 1 AND a.doc = b.doc AND a.page = b.page AND a.kx = b.kx AND a.ky = b.ky AND a.seg_id <> b.seg_id JOIN lv c ON b.doc = c.doc AND b.page = c.page AND b.gx = c.kx AND b.gy = c.ky AND b.seg_id <> c.seg_id
  JOIN up d ON c.doc = d.doc AND c.page = d.page AND c.gx = d.kx AND c.gy = d.ky AND c.seg_id <> d.seg_id AND sqrt(power(d.fx - a.fx, 2) + power(d.fy - a.fy, 2)) <= 0.15),
w AS MATERIALIZED (SELECT * FROM walk b WHERE greatest(x1 - x0, y1 - y0) <= 15 OR EXISTS (SELECT 1 FROM fields t WHERE t.text_id % 3 = 0 AND t.doc = b.doc AND t.page = b.page AND (t.x0 + t.x1) / 2 > b.x0 AND (t.x0 + t.x1) / 2 < b.x1 AND (t.y0 + t.y1) / 2 > b.y0 AND (t.y0 + t.y1) / 2 < b.y1)
  OR EXISTS (SELECT 1 FROM parts p WHERE p.i % 9 = 0 AND p.doc = b.doc AND p.page = b.page AND b.x0 >= p.x - 40 AND b.x1 <= p.x + 60 AND b.y0 >= p.y - 40 AND b.y1 <= p.y + 60))"""

JOBS = {
    "port_outlines": (port_outlines, with_ctes(f"{_PORTS} SELECT * FROM found", "diags", "edges")),
    "port_strokes": (port_strokes, with_ctes(f"{_PORTS} SELECT doc, page, m AS seg_id FROM accepted UNION SELECT doc, page, n FROM accepted UNION SELECT a.doc, a.page, b.seg_id FROM accepted a JOIN back b USING (id)", "diags", "edges")),
    "symbols_outside_ports": (symbols_outside_ports, with_ctes(f"{_PORTS} SELECT m.* FROM marks m WHERE NOT EXISTS (SELECT 1 FROM found p WHERE p.doc = m.doc AND p.page = m.page AND m.x0 >= p.x0 - 0.3 AND m.x1 <= p.x1 + 0.3 AND m.y0 >= p.y0 - 0.3 AND m.y1 <= p.y1 + 0.3)", "diags", "edges", "marks")),
    "rect_from_lines": (rect_from_lines, with_ctes(f"{_LINES} {_BOXES}", "frames")),
    "rect_lines_used": (rect_lines_used, with_ctes(f"{_LINES} SELECT DISTINCT doc, page, seg_id FROM (SELECT doc, page, unnest([l, b, c, d]) AS seg_id FROM good) z", "frames")),
    "rect_from_wires": (rect_from_wires, with_ctes(f"{_WIRES}, {_FIT('w')} SELECT w.doc, w.page, w.l AS line, x0, y0, x1, y1 FROM w JOIN kept USING (doc, page, l)", "frames", "fields")),
}
