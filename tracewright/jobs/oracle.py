"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from ..functions import text_rules as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dist(px, py, x1, y1, x2, y2) -> str:
    """Distance of a point from a segment."""
    t = f"(CASE WHEN ({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1}) > 0 THEN least(1.0, greatest(0.0, (({px}-{x1})*({x2}-{x1})+({py}-{y1})*({y2}-{y1}))/(({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1})))) ELSE 0.0 END)"
    return f"sqrt(({x1}+{t}*({x2}-{x1})-{px})*({x1}+{t}*({x2}-{x1})-{px})+({y1}+{t}*({y2}-{y1})-{py})*({y1}+{t}*({y2}-{y1})-{py}))"


def power(s: str) -> str:
    return f"regexp_matches({s}, {q('(?i)' + R.POWER)})"


def gap(a: tuple, b: tuple) -> str:
    gx, gy = f"greatest({b[0]}-({a[2]}), {a[0]}-({b[2]}), 0)", f"greatest({b[1]}-({a[3]}), {a[1]}-({b[3]}), 0)"
    return f"sqrt({gx}*{gx}+{gy}*{gy})"


def natural(s: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(upper({s}), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(CAST(length(ltrim(p, '0')) AS STRING), 3, '0') || ltrim(p, '0') ELSE p END), '')"


ENDS = "ends AS (SELECT doc, page, seg_id, x1 AS x, y1 AS y FROM segs UNION ALL SELECT doc, page, seg_id, x2, y2 FROM segs)"
SHARED = "e1 AS (SELECT DISTINCT a.doc, a.page, a.seg_id AS src, b.seg_id AS dst FROM ends a JOIN ends b ON a.doc = b.doc AND a.page = b.page AND a.seg_id < b.seg_id AND a.x = b.x AND a.y = b.y)"
ON = f"onseg AS (SELECT e.doc, e.page, e.seg_id AS a, s.seg_id AS b, e.x, e.y FROM ends e JOIN segs s ON e.doc = s.doc AND e.page = s.page AND e.seg_id <> s.seg_id AND {dist('e.x', 'e.y', 's.x1', 's.y1', 's.x2', 's.y2')} <= 0.15)"
TEE = "e2 AS (SELECT DISTINCT o.doc, o.page, least(a, b) AS src, greatest(a, b) AS dst FROM onseg o JOIN dots d ON d.doc = o.doc AND d.page = o.page AND sqrt((d.x - o.x) * (d.x - o.x) + (d.y - o.y) * (d.y - o.y)) <= d.r + 0.3)"
_LAP = "least(greatest(a.{c}1, a.{c}2), greatest(b.{c}1, b.{c}2)) - greatest(least(a.{c}1, a.{c}2), least(b.{c}1, b.{c}2)) > 0.15"
OVERLAP = f"e3 AS (SELECT DISTINCT a.doc, a.page, a.seg_id AS src, b.seg_id AS dst FROM segs a JOIN segs b ON a.doc = b.doc AND a.page = b.page AND a.seg_id < b.seg_id AND ((a.x1 = a.x2 AND b.x1 = b.x2 AND a.x1 = b.x1 AND {_LAP.format(c='y')}) OR (a.y1 = a.y2 AND b.y1 = b.y2 AND a.y1 = b.y1 AND {_LAP.format(c='x')})))"
HITS = f"hits AS (SELECT d.doc, d.page, d.x, d.y, d.r, s.seg_id FROM dots d JOIN segs s ON d.doc = s.doc AND d.page = s.page AND {dist('d.x', 'd.y', 's.x1', 's.y1', 's.x2', 's.y2')} <= greatest(d.r * 0.6, 0.15))"
THROUGH = "e4 AS (SELECT DISTINCT h.doc, h.page, m.src, h.seg_id AS dst FROM hits h JOIN (SELECT doc, page, x, y, min(seg_id) AS src FROM hits GROUP BY doc, page, x, y) m ON h.doc = m.doc AND h.page = m.page AND h.x = m.x AND h.y = m.y WHERE m.src <> h.seg_id)"
CONTACTS = f"{ENDS}, {SHARED}, {ON}, {TEE}, {OVERLAP}, {HITS}, {THROUGH}, touch AS (SELECT * FROM e1 UNION SELECT * FROM e2 UNION SELECT * FROM e3 UNION SELECT * FROM e4)"


def components(edges: str) -> str:
    """CTEs up to cc(doc, page, seg_id, root) over the edges of a CTE."""
    return f"""both_ways AS (SELECT doc, page, src, dst FROM {edges} UNION SELECT doc, page, dst, src FROM {edges}),
reach(doc, page, node, root) AS (SELECT doc, page, seg_id, seg_id FROM segs UNION SELECT e.doc, e.page, e.dst, r.root FROM reach r JOIN both_ways e ON r.doc = e.doc AND r.page = e.page AND r.node = e.src WHERE r.root < e.dst),
cc AS (SELECT doc, page, node AS seg_id, min(root) AS root FROM reach GROUP BY doc, page, node)"""


_LEVEL = "t.rot = 0"
_ALONG = lambda x, y: f"(CASE WHEN {_LEVEL} THEN {x} - t.ax ELSE t.ay - {y} END)"
_OFF = f"((CASE WHEN {_LEVEL} THEN t.ay - s.y1 ELSE t.ax - s.x1 END) + (CASE WHEN {_LEVEL} THEN t.ay - s.y2 ELSE t.ax - s.x2 END)) / 2"
_LEN = f"greatest(CASE WHEN {_LEVEL} THEN t.x1 - t.x0 ELSE t.y1 - t.y0 END, t.size * 0.5)"
_LO, _HI = (f"{f}({_ALONG('s.x1', 's.y1')}, {_ALONG('s.x2', 's.y2')})" for f in ("least", "greatest"))
LABELS = f"""along AS (SELECT t.doc, t.page, t.text_id, t.str, s.seg_id, abs({_OFF} + t.size * 0.12) AS score FROM texts t JOIN segs s ON t.doc = s.doc AND t.page = s.page
  AND abs(CASE WHEN {_LEVEL} THEN s.x2 - s.x1 ELSE s.y2 - s.y1 END) / greatest(sqrt((s.x2-s.x1)*(s.x2-s.x1)+(s.y2-s.y1)*(s.y2-s.y1)), 0.000001) >= 0.97
  AND {_OFF} >= t.size * -0.6 AND {_OFF} <= t.size * 0.3
  AND (({_LO} <= t.size * 0.5 AND {_HI} >= t.size * -0.5) OR ({_LO} <= {_LEN} + t.size * 0.5 AND {_HI} >= {_LEN} - t.size * 0.5))),
labels0 AS (SELECT doc, page, text_id, str, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY score, seg_id) AS r FROM along) z WHERE r = 1)"""
NAMES = "labels1 AS (SELECT * FROM labels0 WHERE NOT regexp_matches(str, '(?i)^[0-9]+([.,][0-9]+)?V[0-9]*$')), e5 AS (SELECT DISTINCT l.doc, l.page, m.src, l.seg_id AS dst FROM labels1 l JOIN (SELECT doc, page, upper(str) AS name, min(seg_id) AS src FROM labels1 GROUP BY doc, page, upper(str)) m ON l.doc = m.doc AND l.page = m.page AND upper(l.str) = m.name WHERE m.src <> l.seg_id)"
NETS = f"""{CONTACTS}, {LABELS}, {NAMES}, all_edges AS (SELECT * FROM touch UNION SELECT * FROM e5), {components('all_edges')},
numbered AS (SELECT doc, page, seg_id, dense_rank() OVER (PARTITION BY doc, page ORDER BY root) - 1 AS net_id FROM cc),
wires AS (SELECT s.*, n.net_id FROM segs s JOIN numbered n ON s.doc = n.doc AND s.page = n.page AND s.seg_id = n.seg_id),
labels AS (SELECT l.doc, l.page, l.text_id, l.str, l.seg_id, n.net_id FROM labels1 l JOIN numbered n ON l.doc = n.doc AND l.page = n.page AND l.seg_id = n.seg_id),
built AS (SELECT doc, page, net_id, count(*) AS n_segs, min(seg_id) AS first_seg, min(least(x1, x2)) AS bx0, min(least(y1, y2)) AS by0, max(greatest(x1, x2)) AS bx1, max(greatest(y1, y2)) AS by1 FROM wires GROUP BY doc, page, net_id),
picked AS (SELECT doc, page, net_id, str AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, net_id ORDER BY CASE WHEN {power('str')} THEN 0 ELSE 1 END, str, text_id) AS r FROM labels) z WHERE r = 1),
nets AS (SELECT b.*, coalesce(p.name, '') AS name FROM built b LEFT JOIN picked p ON b.doc = p.doc AND b.page = p.page AND b.net_id = p.net_id)"""
ENTRIES = f"""spelled AS (SELECT n.doc, upper(n.name) AS key, count(*) AS labels FROM labels l JOIN nets n ON l.doc = n.doc AND l.page = n.page AND l.net_id = n.net_id WHERE upper(l.str) = upper(n.name) GROUP BY n.doc, upper(n.name)),
rolled AS (SELECT doc, upper(name) AS key, arg_min(name, page * 1000000 + net_id) AS net, count(*) AS n_nets, CAST(sum(n_segs) AS BIGINT) AS n_segs, array_to_string(list_sort(list(DISTINCT page + 1)), ' ') AS pages FROM nets WHERE name <> '' GROUP BY doc, upper(name)),
entries AS (SELECT r.doc, net, CASE WHEN {power('net')} THEN 'power' ELSE 'signal' END AS type, coalesce(labels, 0) AS labels, pages, n_nets, n_segs FROM rolled r LEFT JOIN spelled s ON r.doc = s.doc AND r.key = s.key)"""
