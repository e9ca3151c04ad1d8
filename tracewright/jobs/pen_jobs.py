"""Queries on lettering pens and on links around parts and labels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import part_links as K
from ..operators import pens as P
from ..sources.fixtures import tables, with_ctes
from ..sources.shared import written
from . import oracle as O
from .label_jobs import _BARE, _CAND, _ENDS, _H, _IN, _MX, _MY, _NEAR
from .oracle import power
from .page_jobs import LETTERS, letters
from .scalar_jobs import kinds


def _t(spark, sf, *names):
    return tables(spark, sf, *names)


def pen_roles(spark, sf):
    texts, segs, marks, flags = _t(spark, sf, "lettered", "segs", "marks", "flags")
    return P.pen_roles(texts, L.attach_labels(texts, segs, marks, flags, monochrome=False))


def _settled(spark, sf):
    texts, segs, marks, flags = _t(spark, sf, "lettered", "segs", "marks", "flags")
    return P.settled_labels(written(texts, "lettered"), written(segs, "segs"), marks, flags)


def pen_kinds(spark, sf):
    """Kinds of all texts once their pens are known."""
    return _settled(spark, sf)[0].select("doc", "page", "text_id", "kind")


def pen_labels(spark, sf):
    """Labels on wires once the pens are known."""
    return _settled(spark, sf)[1]


def _colours(spark, sf):
    return letters(spark, sf).withColumn("color", F.when(F.col("text_id") % 5 > 0, F.when(F.col("text_id") % 7 < 4, "#0000aa").otherwise("#aa0000")))


def sentence_pairs(spark, sf):
    return P.sentence_pairs(letters(spark, sf), ["y"])


def sentence_pen_restore(spark, sf):
    """Kinds of the words of documents after notes of two pens are undone."""
    return P.kinds_by_sentence(_colours(spark, sf).drop("str"), ["y"]).select("doc", "page", "text_id", "kind")


def _part_links(spark, sf):
    return K.part_link_rows(*_t(spark, sf, "part_links", "sheet_texts", "heights"))


def part_link_rows(spark, sf):
    return _part_links(spark, sf).select("doc", "page", "link_id", "ref", F.array_join("values", "|").alias("values"), "has_text")


def part_link_kinds(spark, sf):
    """Kinds of all texts where links state them."""
    nets, texts = _t(spark, sf, "net_links", "sheet_texts")
    return K.rekind_by_links(texts, *K.trusted(_part_links(spark, sf), nets, texts)).select("doc", "page", "text_id", "kind", "in_body", "linked")


def components_with_links(spark, sf):
    """Parts read from the drawing, one value each, as trusted links complete them."""
    nets, texts, parts = _t(spark, sf, "net_links", "sheet_texts", "parts")
    _, links, _ = K.trusted(_part_links(spark, sf), nets, texts)
    read = parts.where("i % 4 <> 2").select("doc", "page", "ref", F.when(F.col("value").isNotNull(), F.array("value")).otherwise(F.array().cast("array<string>")).alias("values"))
    return K.components_with_links(read, links).select("doc", "page", "ref", F.array_join("values", "|").alias("values"), "from_link")


def _again(sql: str, n: int) -> str:
    """CTEs of the attachment under names of their own, over the texts and flags of one pass."""
    for name in ("along", "labels0", "cand", "ends1", "ends2", "ends3", "texts", "flags"):
        sql = re.sub(rf"(?<!['.\w]){name}(?!['\w])", f"{name}_{n}", sql)
    return sql


_W = lambda c: f"(CASE WHEN {_H('s.x1', 's.y1')} <= {_H('s.x2', 's.y2')} THEN s.{c}1 ELSE s.{c}2 END)"


def _pass(n: int) -> str:
    """CTEs from texts_n (with role) and flags_n up to attached_n, in colour."""
    at = lambda c: f"(CASE WHEN {_IN(1)} THEN s.{c}1 ELSE s.{c}2 END)"
    off = f"CASE WHEN abs(s.x1 - s.x2) < 0.02 THEN {at('x')} NOT BETWEEN t.x0 - t.size * 0.3 AND t.x1 + t.size * 0.3 ELSE {at('y')} NOT BETWEEN t.y0 - t.size * 0.3 AND t.y1 + t.size * 0.3 END"
    ends = f"""ends3 AS (SELECT doc, page, text_id, sym_id, seg_id FROM (SELECT c.doc, c.page, c.text_id, c.sym_id, e.seg_id, row_number() OVER (PARTITION BY c.doc, c.page, c.text_id, c.sym_id ORDER BY {off}, e.d, e.seg_id) AS r FROM cand c JOIN ends1 e ON c.doc = e.doc AND c.page = e.page AND c.sym_id = e.sym_id
 JOIN segs s ON s.doc = e.doc AND s.page = e.page AND s.seg_id = e.seg_id JOIN texts t ON t.doc = c.doc AND t.page = c.page AND t.text_id = c.text_id JOIN marks m ON m.doc = c.doc AND m.page = c.page AND m.sym_id = c.sym_id) z WHERE r = 1)"""
    rules = f"""rules AS (SELECT t.doc, t.page, t.text_id, t.seg_id, 1 AS rule, 'along' AS via, true AS port FROM labels0 t JOIN texts x USING (doc, page, text_id) WHERE NOT {_BARE} AND x.role NOT IN ('field', 'pin') UNION ALL SELECT *, 2, 'flag', true FROM {_NEAR('flags', '0.6', 'true')}
UNION ALL SELECT c.doc, c.page, c.text_id, arg_min(s.seg_id, c.r), 3, 'symbol', true FROM cand c JOIN ends3 e ON c.doc = e.doc AND c.page = e.page AND c.sym_id = e.sym_id AND c.text_id = e.text_id JOIN segs s ON s.doc = e.doc AND s.page = e.page AND s.seg_id = e.seg_id JOIN texts t ON t.doc = c.doc AND t.page = c.page AND t.text_id = c.text_id JOIN marks m ON m.doc = c.doc AND m.page = c.page AND m.sym_id = c.sym_id
 WHERE least({_H('s.x1', 's.y1')}, {_H('s.x2', 's.y2')}) + 0.1 >= {_H(_MX, _MY)} AND t.role <> 'pin' AND (t.role <> 'field' OR {power('t.str')} OR CASE WHEN abs(s.x1 - s.x2) < 0.02 THEN abs({_W('x')} - (t.x0 + t.x1) / 2) <= t.size * 0.6 + (t.x1 - t.x0) * 0.1 ELSE {_W('y')} BETWEEN t.y0 - t.size * 0.5 AND t.y1 + t.size * 0.5 END) GROUP BY c.doc, c.page, c.text_id
UNION ALL SELECT t.doc, t.page, t.text_id, t.seg_id, 4, 'along', true FROM labels0 t JOIN texts x USING (doc, page, text_id) WHERE x.role = 'field' AND {power('x.str')} AND NOT {_BARE.replace('t.str', 'x.str')})"""
    top = f"attached_{n} AS MATERIALIZED (SELECT doc, page, text_id, seg_id, via, port FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY rule) AS r FROM rules_{n}) z WHERE r = 1)"
    return f"{_again(f'{O.LABELS}, {_CAND}, {_ENDS}, {ends}, {rules}', n).replace('rules AS (', f'rules_{n} AS (', 1)}, {top}"


_PENS = """lt AS (SELECT doc, page, color, text_id, kind FROM lettered WHERE color IS NOT NULL),
marks_of AS (SELECT t.doc, t.page, t.color, count(*) FILTER (a.via NOT IN ('symbol', 'ground')) AS lab, count(*) FILTER (a.via = 'flag') AS flag FROM lt t JOIN attached_1 a USING (doc, page, text_id) GROUP BY t.doc, t.page, t.color),
pens AS (SELECT t.doc, t.page, t.color, count(*) AS n, count(*) FILTER (kind = 'pin') AS num, count(*) FILTER (kind = 'component') AS ref, count(*) FILTER (kind = 'note') AS note, coalesce(any_value(m.lab), 0) AS lab, coalesce(any_value(m.flag), 0) AS flag FROM lt t LEFT JOIN marks_of m USING (doc, page, color) GROUP BY t.doc, t.page, t.color),
lp AS (SELECT *, lab >= 4 AND ref * 10 <= lab AND note * 10 <= lab AS label FROM pens), topped AS (SELECT lp.*, t.top FROM lp JOIN (SELECT doc, page, max(lab) AS top FROM lp WHERE label GROUP BY doc, page) t USING (doc, page)),
roles AS MATERIALIZED (SELECT doc, page, color, role FROM (SELECT *, CASE WHEN label THEN 'label' WHEN lab * 3 > top THEN NULL WHEN ref >= 6 AND lab * 5 <= ref AND ref >= note THEN 'field' WHEN n >= 10 AND num * 2 >= n THEN 'pin' WHEN note >= 4 AND ref * 3 <= note AND lab * 2 <= note AND flag = 0 THEN 'note' END AS role FROM topped) z WHERE role IS NOT NULL)"""
_SETTLED = "settled AS MATERIALIZED (SELECT t.* EXCLUDE (kind), coalesce(r.role, '') AS role, CASE WHEN r.role = 'note' AND kind NOT IN ('note', 'pin') THEN 'note' WHEN r.role = 'label' AND kind = 'component' THEN 'net' WHEN r.role = 'pin' AND kind IN ('component', 'value') THEN 'pin' ELSE kind END AS kind FROM lettered t LEFT JOIN roles r USING (doc, page, color))"
_FIRST = f"texts_1 AS MATERIALIZED (SELECT *, '' AS role FROM lettered WHERE kind = 'net'), flags_1 AS (SELECT * FROM flags), {_pass(1)}, {_PENS}"
_SECOND = f"texts_2 AS MATERIALIZED (SELECT * FROM settled WHERE kind = 'net'), flags_2 AS (SELECT f.* FROM flags f JOIN texts_2 t USING (doc, page, text_id) WHERE t.role <> 'field'), {_pass(2)}"
_SHARED_CELL = "floor(t.x1 / 10) >= floor(l.x0 / 10) AND floor(t.x0 / 10) <= floor(l.x1 / 10) AND floor(t.y1 / 10) >= floor(l.y0 / 10) AND floor(t.y0 / 10) <= floor(l.y1 / 10)"
_LINKS = f"""kinds AS MATERIALIZED (SELECT str, {kinds('str')} AS kind FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\r?\\n')) AS raw, trim(raw) AS str FROM part_links WHERE text IS NOT NULL) z),
refs_of AS MATERIALIZED (SELECT list(str) AS names FROM kinds WHERE kind = 'component'),
pl AS (SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda s: trim(s)), lambda s: s <> '') AS lines, CASE WHEN regexp_matches(ref_prop, '(?i)^[A-Z][A-Za-z0-9_-]{{0,15}}$') THEN ref_prop END AS prop, nullif(value_prop, '') AS val FROM part_links),
pi AS MATERIALIZED (SELECT l.doc, l.page, l.link_id, list(DISTINCT t.str) AS inside FROM pl l JOIN sheet_texts t ON l.doc = t.doc AND l.page = t.page AND {_SHARED_CELL} GROUP BY l.doc, l.page, l.link_id),
pr AS (SELECT l.*, coalesce(i.inside, []) AS inside, coalesce(prop, list_filter(lines, lambda s: list_contains(r.names, s) AND list_contains(coalesce(i.inside, []), s))[1]) AS ref FROM pl l LEFT JOIN pi i USING (doc, page, link_id), refs_of r WHERE len(lines) > 0 OR ref_prop IS NOT NULL OR value_prop IS NOT NULL),
rows_of AS MATERIALIZED (SELECT doc, page, link_id, x0, y0, x1, y1, ref, CASE WHEN val IS NOT NULL THEN [val] WHEN len(lines) <= 4 THEN list_filter(lines, lambda s: s <> ref AND list_contains(inside, s)) ELSE [] END AS vals, list_contains(inside, ref) AS has_text FROM pr WHERE ref IS NOT NULL)"""
_GATE = """c AS (SELECT l.doc, l.page, l.link_id, t.text_id, greatest(0, least(t.x1, l.x1) - greatest(t.x0, l.x0)) * greatest(0, least(t.y1, l.y1) - greatest(t.y0, l.y0)) AS a FROM net_links l JOIN sheet_texts t ON l.doc = t.doc AND l.page = t.page AND (t.x0 + t.x1) / 2 BETWEEN l.x0 - 0.3 * t.size AND l.x1 + 0.3 * t.size AND (t.y0 + t.y1) / 2 BETWEEN l.y0 - 0.3 * t.size AND l.y1 + 0.3 * t.size),
lab AS MATERIALIZED (SELECT DISTINCT doc, page, text_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, link_id ORDER BY a DESC, text_id) AS r FROM c WHERE a > 0) z WHERE r = 1),
gate AS MATERIALIZED (SELECT doc, page, CAST(sum(l) AS BIGINT) AS labels FROM (SELECT doc, page, 1 AS l, 0 AS p, 0 AS ch FROM lab UNION ALL SELECT doc, page, 0, 1, 0 FROM rows_of UNION ALL SELECT doc, page, 0, 0, 1 FROM net_links WHERE chained) z GROUP BY doc, page HAVING sum(l) >= 3 OR sum(p) >= 3 OR sum(ch) >= 3)"""

JOBS = {
    "pen_roles": (pen_roles, with_ctes(f"{_FIRST} SELECT * FROM roles", "texts", "marks", "flags", "lettered")),
    "pen_kinds": (pen_kinds, with_ctes(f"{_FIRST}, {_SETTLED} SELECT doc, page, text_id, kind FROM settled", "texts", "marks", "flags", "lettered")),
    "pen_labels": (pen_labels, with_ctes(f"{_FIRST}, {_SETTLED}, {_SECOND} SELECT * FROM attached_2", "texts", "marks", "flags", "lettered")),
    "part_link_rows": (part_link_rows, with_ctes(f"{_LINKS} SELECT doc, page, link_id, ref, array_to_string(vals, '|') AS values, has_text FROM rows_of", "part_links", "sheet_texts")),
    "part_link_kinds": (part_link_kinds, with_ctes(f"""{_LINKS}, {_GATE}, base AS (SELECT t.*, g.labels, l.text_id IS NOT NULL AND g.doc IS NOT NULL AS linked FROM sheet_texts t LEFT JOIN gate g USING (doc, page) LEFT JOIN lab l USING (doc, page, text_id)),
h AS (SELECT t.doc, t.page, t.text_id, p.link_id, CASE WHEN t.str = p.ref THEN 'component' WHEN list_contains(p.vals, t.str) THEN 'value' END AS says FROM base t JOIN rows_of p ON t.doc = p.doc AND t.page = p.page AND NOT t.linked AND t.labels IS NOT NULL AND (t.x0 + t.x1) / 2 BETWEEN p.x0 AND p.x1 AND (t.y0 + t.y1) / 2 BETWEEN p.y0 AND p.y1),
n AS (SELECT doc, page, text_id, arg_max(says, link_id) FILTER (says IS NOT NULL) AS says, max(link_id) FILTER (says IS NOT NULL) AS last, max(link_id) FILTER (says IS NULL) AS body FROM h GROUP BY doc, page, text_id),
k AS (SELECT b.doc, b.page, b.text_id, coalesce(n.says, CASE WHEN b.linked THEN 'net' WHEN b.labels >= 3 AND b.kind = 'net' THEN 'note' ELSE b.kind END) AS kind, n.body, n.last, b.linked FROM base b LEFT JOIN n USING (doc, page, text_id))
SELECT doc, page, text_id, CASE WHEN body IS NOT NULL AND body > coalesce(last, -1) AND kind IN ('component', 'net') THEN 'pin' ELSE kind END AS kind, body IS NOT NULL AS in_body, linked FROM k""", "part_links", "net_links", "sheet_texts")),
    "components_with_links": (components_with_links, with_ctes(f"""{_LINKS}, {_GATE}, rd AS (SELECT doc, page, ref, CASE WHEN value IS NULL THEN [] ELSE [value] END AS vals FROM parts WHERE i % 4 <> 2), pt AS (SELECT r.* FROM rows_of r JOIN gate USING (doc, page)),
l AS (SELECT doc, page, ref, min(link_id) FILTER (NOT has_text) AS born, max(link_id) FILTER (len(vals) > 0) AS at, arg_max(vals, link_id) FILTER (len(vals) > 0) AS vals FROM pt GROUP BY doc, page, ref)
SELECT doc, page, ref, array_to_string(CASE WHEN rd.vals IS NOT NULL THEN coalesce(l.vals, rd.vals) WHEN l.at >= l.born THEN l.vals ELSE [] END, '|') AS values, rd.vals IS NULL AS from_link FROM rd FULL JOIN l USING (doc, page, ref) WHERE rd.vals IS NOT NULL OR l.born IS NOT NULL""", "part_links", "net_links", "sheet_texts")),
    "sentence_pairs": (sentence_pairs, f"""WITH {LETTERS}, a AS (SELECT *, lag(x1) OVER w AS px, lag(size) OVER w AS ps, lag(kind) OVER w AS pk, lag(text_id) OVER w AS pi FROM letters WINDOW w AS (PARTITION BY doc, page, y ORDER BY x0, text_id)), b AS (SELECT *, coalesce(x0 - px > -0.3 AND x0 - px < least(size, ps) * 0.6 AND kind <> 'pin' AND pk <> 'pin', false) AS joined FROM a),
c AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page, y ORDER BY x0, text_id) AS run FROM b), d AS (SELECT *, max(CASE WHEN kind <> 'value' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, y, run ORDER BY x0, text_id) AS seen FROM c),
pairs AS MATERIALIZED (SELECT doc, page, pi AS a, text_id AS b FROM d WHERE joined AND seen = 1) SELECT * FROM pairs"""),
}
_PAIRS = JOBS["sentence_pairs"][1].removesuffix(" SELECT * FROM pairs")
JOBS["sentence_pen_restore"] = (sentence_pen_restore, f"""{_PAIRS}, col AS (SELECT doc, page, text_id, kind, CASE WHEN text_id % 5 > 0 THEN CASE WHEN text_id % 7 < 4 THEN '#0000aa' ELSE '#aa0000' END END AS color FROM letters),
st AS (SELECT p.doc, p.page, p.a, p.b, coalesce(x.color = y.color, true) AS stays FROM pairs p JOIN col x ON x.doc = p.doc AND x.page = p.page AND x.text_id = p.a JOIN col y ON y.doc = p.doc AND y.page = p.page AND y.text_id = p.b),
m AS (SELECT doc, page, text_id, bool_or(stays) AS stays FROM (SELECT doc, page, a AS text_id, stays FROM st UNION ALL SELECT doc, page, b, stays FROM st) z GROUP BY doc, page, text_id)
SELECT c.doc, c.page, c.text_id, CASE WHEN m.stays THEN 'note' ELSE c.kind END AS kind FROM col c LEFT JOIN m USING (doc, page, text_id)""")
