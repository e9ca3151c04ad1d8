"""Drawings derived from the given tables: SQL that Spark and DuckDB read alike, so that both sides of a check see the same rows.
Spark makes segs by ``dealt_segs`` instead, which shuffles once and gives the rows of their SQL.

Tables: segs(doc, page, seg_id, x1, y1, x2, y2, style, width), dots(doc, page, x, y, r), texts(doc, page, text_id, str, kind, x0, y0, x1, y1, ax, ay, size, rot),
strings(k, str), gt_wires(doc, page, wire_id, net, x1, y1, x2, y2), parts(doc, page, ref, x, y, value, vx, vy), pins(doc, page, pin, net, x, y).
A drawing (doc) has five pages, counted from 0 in each. All coordinates are integers or quarters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import by_page

DIV = "CAST(floor({} / {}) AS BIGINT)"

SQL: dict[str, str] = {
    "segs": """
SELECT CAST(floor(sheet / 5) AS BIGINT) AS doc, sheet % 5 AS page, CAST(row_number() OVER (PARTITION BY sheet ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS BIGINT) AS seg_id,
  x AS x1, y AS y1, CASE WHEN h = 0 THEN x + len ELSE x END AS x2, CASE WHEN h = 0 THEN y ELSE y + len END AS y2, style, width
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_orderkey / 150) AS BIGINT) AS sheet, CAST((l_partkey * 31 + l_linenumber * 7) % 60 * 10 AS DOUBLE) AS x,
    CAST((l_suppkey * 17 + l_orderkey * 3) % 60 * 10 AS DOUBLE) AS y, l_linenumber % 2 AS h, CAST(10 * (1 + min(CAST(l_quantity AS BIGINT)) % 6) AS DOUBLE) AS len,
    CASE WHEN l_partkey % 5 < 3 THEN 'AF' ELSE min(l_returnflag) || min(l_linestatus) END AS style, CAST(min(CAST(l_quantity AS BIGINT)) % 4 AS DOUBLE) / 4 + 0.25 AS width
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) g""",
    "dots": """
SELECT DISTINCT CAST(floor(o_orderkey / 750) AS BIGINT) AS doc, CAST(floor(o_orderkey / 150) AS BIGINT) % 5 AS page, CAST((o_custkey * 13 + o_orderkey) % 60 * 10 AS DOUBLE) AS x, CAST((o_custkey * 7 + o_orderkey * 11) % 60 * 10 AS DOUBLE) AS y,
  CAST(1.0 AS DOUBLE) AS r FROM {orders}""",
    "texts": """
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY seg_id) - 1 AS BIGINT) AS text_id, str, CAST('net' AS STRING) AS kind,
  CASE WHEN rot = 0 THEN ax ELSE ax - 5 END AS x0, CASE WHEN rot = 0 THEN ay - 5 ELSE ay - 3 * length(str) END AS y0,
  CASE WHEN rot = 0 THEN ax + 3 * length(str) ELSE ax END AS x1, ay AS y1, ax, ay, CAST(5.0 AS DOUBLE) AS size, rot
FROM (SELECT doc, page, seg_id, CASE WHEN y1 = y2 THEN 0 ELSE -90 END AS rot, CASE WHEN y1 = y2 THEN x1 + 2 ELSE x1 - 1 END AS ax, CASE WHEN y1 = y2 THEN y1 - 1 ELSE y2 - 2 END AS ay,
    CASE (doc * 5 + page * 7 + seg_id) % 12 WHEN 0 THEN 'GND' WHEN 1 THEN '+3.3V' WHEN 2 THEN 'VCC' WHEN 3 THEN '5V' WHEN 4 THEN 'gnd' WHEN 5 THEN 'EN' ELSE 'SIG_' || CAST((page * 3 + seg_id) % 17 AS STRING) END AS str
  FROM segs WHERE seg_id % 5 = 0) t""",
    "strings": """
SELECT k, CASE k % 24 WHEN 0 THEN CAST(k % 20000 AS STRING) WHEN 1 THEN 'A' || CAST(k % 15 AS STRING) WHEN 2 THEN 'PWR_FLAG' WHEN 3 THEN '+' || CAST(k % 13 AS STRING) || '.3V' WHEN 4 THEN 'vcc_' || CAST(k % 9 AS STRING)
  WHEN 5 THEN CAST(k % 100 AS STRING) || 'nF/16V' WHEN 6 THEN CAST(k % 10 AS STRING) || 'k' || CAST(k % 7 AS STRING) WHEN 7 THEN 'two words ' || CAST(k AS STRING) WHEN 8 THEN 'V=' || CAST(k AS STRING) WHEN 9 THEN 'GPIO' || CAST(k % 40 AS STRING) || ':'
  WHEN 10 THEN 'Q' || CAST(k % 30 AS STRING) || 'MHz/20pF/10ppm' WHEN 11 THEN 'USB-UART' || CAST(k % 20 AS STRING) WHEN 12 THEN '*U' || CAST(k % 50 AS STRING) WHEN 13 THEN 'R' || CAST(k % 3000 AS STRING) WHEN 14 THEN 'U' || CAST(k % 90 AS STRING) || 'A'
  WHEN 15 THEN 'WCN_' || CAST(k % 5 AS STRING) WHEN 16 THEN 'LM' || CAST(k % 9000 AS STRING) || '-ADJ' WHEN 17 THEN '1N5819S' || CAST(k % 9 AS STRING) || '(SOD-123)' WHEN 18 THEN 'x' WHEN 19 THEN '--' WHEN 20 THEN 'SPI' || CAST(k % 4 AS STRING) WHEN 21 THEN '  ' WHEN 22 THEN 'DNP' ELSE 'SIG_' || CAST(k % 99 AS STRING) END AS str
FROM (SELECT DISTINCT l_orderkey * 7 + l_linenumber AS k FROM {lineitem}) s""",
    "gt_wires": """
SELECT doc, page, seg_id AS wire_id, CAST(floor(seg_id / 4) AS BIGINT) AS net, x1 + 0.25 AS x1, y1 + 0.25 AS y1, CASE WHEN seg_id % 13 = 0 THEN (x1 + x2) / 2 ELSE x2 END + 0.25 AS x2, CASE WHEN seg_id % 13 = 0 THEN (y1 + y2) / 2 ELSE y2 END + 0.25 AS y2
FROM segs WHERE seg_id % 11 <> 0""",
    "parts": """
SELECT CAST(floor(sheet / 5) AS BIGINT) AS doc, sheet % 5 AS page, CASE o_orderkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'C' WHEN 2 THEN 'U' ELSE 'L' END || CAST(i AS STRING) AS ref, i, CAST((o_custkey * 13 + o_orderkey) % 60 * 10 AS DOUBLE) AS x, CAST((o_custkey * 7 + o_orderkey * 11) % 60 * 10 AS DOUBLE) AS y,
  CASE WHEN i % 10 <> 9 THEN CAST(o_custkey % 30 AS STRING) || CASE o_orderkey % 4 WHEN 0 THEN 'k' WHEN 1 THEN 'nF' WHEN 2 THEN 'MHz' ELSE 'uH' END END AS value,
  CASE i % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 0.0 ELSE -10.0 END AS dx, CASE i % 3 WHEN 0 THEN 0.0 ELSE 8.0 END AS dy
FROM (SELECT *, CAST(floor(o_orderkey / 150) AS BIGINT) AS sheet, row_number() OVER (PARTITION BY CAST(floor(o_orderkey / 150) AS BIGINT) ORDER BY o_orderkey, o_custkey) AS i FROM {orders}) o""",
    "pins": """
SELECT CAST(floor(sheet / 5) AS BIGINT) AS doc, sheet % 5 AS page, pin, CAST(min(l_orderkey) % 7 AS BIGINT) AS pred, 'N' || CAST(min(l_orderkey + l_linenumber) % 6 AS STRING) AS gt
FROM (SELECT *, CAST(floor(l_orderkey / 150) AS BIGINT) AS sheet, 'U' || CAST(l_suppkey % 20 AS STRING) || '-' || CAST(l_partkey % 40 AS STRING) AS pin FROM {lineitem}) p GROUP BY sheet, pin""",
    "marks": """
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY x, y) AS BIGINT) AS sym_id, x - 2 AS x0, y - 3 AS y0, x + 2 AS x1, y + 1 AS y1 FROM dots""",
    "strokes": """
SELECT doc, page, text_id * 4 AS prim_id, x0 + 0.5 AS x0, y0 + 0.5 AS y0, x0 + 2.5 AS x1, y1 - 1 AS y1, CASE WHEN text_id % 3 = 0 THEN '#aa0000' ELSE '#0000aa' END AS color FROM texts
UNION ALL SELECT doc, page, text_id * 4 + 1, x0 + 1, y0 + 1, x0 + 4, y0 + 3, CASE WHEN text_id % 3 = 0 THEN '#aa0000' ELSE '#0000aa' END FROM texts
UNION ALL SELECT doc, page, text_id * 4 + 2, x0 + 1, y0 + 2, x0 + 3, y0 + 4, CASE WHEN text_id % 2 = 0 THEN '#00aa00' ELSE '#0000aa' END FROM texts
UNION ALL SELECT doc, page, text_id * 4 + 3, x0 - 9, y0, x0 - 6, y1, '#000000' FROM texts""",
    "links": "SELECT doc, page, text_id AS link_id, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 2 AS x1, y1 + 1 AS y1 FROM texts WHERE text_id % 3 = 0",
    "flags": "SELECT doc, page, text_id, x0 - 1.5 AS x0, y0 - 1.5 AS y0, x1 + 1.5 AS x1, y1 + 1.5 AS y1 FROM texts WHERE text_id % 4 = 1",
    "fields": """
SELECT doc, page, CAST(i * 2 AS BIGINT) AS text_id, CASE i % 6 WHEN 0 THEN 'PWRLED' || CAST(i % 40 AS STRING) WHEN 1 THEN 'R' || CAST(i % 7 AS STRING) ELSE ref END AS str, CASE i % 6 WHEN 0 THEN 'net' ELSE 'component' END AS kind,
  x AS x0, y - 4 AS y0, x + 9 AS x1, y + 1 AS y1, x AS ax, y + 1 AS ay, CAST(5.0 AS DOUBLE) AS size, 0 AS rot, CASE WHEN i % 4 = 1 THEN CAST(i AS BIGINT) END AS net_id, i % 5 = 2 AS in_body FROM parts
UNION ALL SELECT doc, page, CAST(i * 2 + 1 AS BIGINT), value, 'value', x + dx, y + dy - 4, x + dx + 9, y + dy + 1, x + dx, y + dy + 1, 5.0, 0, CAST(NULL AS BIGINT), false FROM parts WHERE value IS NOT NULL""",
    # pins on wire ends, between wires and beside them
    "pin_boxes": """
SELECT doc, page, CAST(i AS BIGINT) AS pin_id, ref AS name, x + dx - CASE WHEN i % 2 = 0 THEN 2 ELSE 0.5 END AS x0, y + dy - CASE WHEN i % 2 = 0 THEN 0.5 ELSE 2 END AS y0, x + dx + CASE WHEN i % 2 = 0 THEN 2 ELSE 0.5 END AS x1, y + dy + CASE WHEN i % 2 = 0 THEN 0.5 ELSE 2 END AS y1
FROM (SELECT doc, page, i, ref, x, y, CASE WHEN i % 3 = 1 THEN 5.0 ELSE 0.25 END AS dx, CASE WHEN i % 3 = 0 THEN 0.0 ELSE 5.0 END AS dy FROM parts) p""",
    # each stroke as a primitive: pens by style, one width that letters, some closed or filled, every fifth page in one grey
    "prims": """
SELECT doc, page, prim_id, CASE WHEN fill THEN 'F' ELSE 'S' END || color || '/' || CAST(width AS STRING) AS style, color, width, fill, closed, glyph, x0, y0, x1, y1
FROM (SELECT doc, page, seg_id AS prim_id, CASE WHEN page % 5 = 4 THEN '#222222' WHEN style = 'AF' THEN '#007700' WHEN style = 'NO' THEN '#0000cc' WHEN style = 'RF' THEN '#cc0000' ELSE '#222222' END AS color, width, seg_id % 17 = 5 AS fill, seg_id % 9 = 1 AS closed,
  style = 'AF' AND width = 0.25 AND seg_id % 13 <> 0 AS glyph, x1 AS x0, y1 AS y0, x2 AS x1, y2 AS y1 FROM segs) p""",
    # stacks of three or four bars, growing, shrinking or uneven at first; on crowded pages some touch the next stack
    "bars": """
SELECT doc, page, level, CASE WHEN level THEN x ELSE y END AS centre, CASE WHEN level THEN y ELSE x END + 2.0 * k AS pos, CASE sym_id % 3 WHEN 0 THEN 8.0 - k WHEN 1 THEN 4.0 + k ELSE CASE WHEN k = 0 THEN 5.0 ELSE 10.0 - k END END AS len
FROM (SELECT doc, page, sym_id, sym_id % 4 < 3 AS level, x0 + 2 AS x, y0 + 3 AS y FROM marks) m CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k) z WHERE k < 3 OR sym_id % 2 = 1""",
    # all texts of a page with their pens: labels, references, pin numbers, notes
    "lettered": """
SELECT doc, page, text_id, str, kind, x0, y0, x1, y1, ax, ay, size, rot, CASE WHEN text_id % 10 = 3 THEN '#f00000' WHEN text_id % 10 = 7 AND page % 2 = 0 THEN '#777777' WHEN text_id % 14 <> 5 THEN '#0000f0' END AS color FROM texts
UNION ALL SELECT doc, page, CAST(100000 + i * 4 AS BIGINT), CASE WHEN i % 6 = 1 THEN 'VCC' ELSE ref END, CASE WHEN i % 6 = 1 THEN 'net' ELSE 'component' END, x, y - 4, x + 9, y + 1, x, y + 1, 5.0, 0, CASE WHEN i % 16 = 0 THEN '#0000f0' ELSE '#f00000' END FROM parts
UNION ALL SELECT doc, page, CAST(100001 + i * 4 AS BIGINT), CAST(i AS STRING), CASE WHEN i % 12 = 2 THEN 'value' WHEN i % 12 = 4 THEN 'net' ELSE 'pin' END, x + 20, y - 4, x + 26, y + 1, x + 20, y + 1, 5.0, 0, '#00a000' FROM parts WHERE i % 2 = 0
UNION ALL SELECT doc, page, CAST(100002 + i * 4 AS BIGINT), 'NOTE', 'note', x - 20, y - 4, x - 8, y + 1, x - 20, y + 1, 5.0, 0, '#777777' FROM parts WHERE i % 4 = 1""",
    # links around parts: some with a script, some with lines only, some that list pins
    "part_links": """
SELECT doc, page, CAST(i AS BIGINT) AS link_id, x - 2 AS x0, y - 6 AS y0, x + 32 AS x1, y + 12 AS y1, CASE i % 5 WHEN 0 THEN ref || chr(10) || coalesce(value, 'NC') WHEN 1 THEN 'U9X ' || chr(13) || chr(10) || ref WHEN 2 THEN ref || chr(10) || '1' || chr(10) || '2' || chr(10) || coalesce(value, '') || chr(10) || '5' || chr(10) || '6' WHEN 3 THEN '' END AS text,
  CASE WHEN i % 5 = 3 THEN ref WHEN i % 7 = 0 THEN '9bad' WHEN i % 11 = 0 THEN 'Z99' END AS ref_prop, CASE WHEN i % 4 = 0 THEN 'V' || CAST(i AS STRING) WHEN i % 4 = 1 THEN '' END AS value_prop FROM parts WHERE page % 3 <> 2 OR i <= 2""",
    "net_links": "SELECT doc, page, text_id AS link_id, x0 - 1 AS x0, y0 - 1 AS y0, x1 + 2 AS x1, y1 + 1 AS y1, text_id % 12 = 0 AS chained FROM texts WHERE text_id % 3 = 0 AND (page % 4 <> 1 OR text_id < 6)",
    "sheet_texts": """
SELECT doc, page, text_id, str, kind, x0, y0, x1, y1, size FROM texts UNION ALL SELECT doc, page, 100000 + text_id, str, kind, x0, y0, x1, y1, size FROM fields""",
    "heights": "SELECT DISTINCT doc, page, CAST(5.0 AS DOUBLE) AS s FROM dots",
    # ports in their own coordinates: u along the body, v across; every third has another one stacked on it
    "ports": """
SELECT doc, page, i, k, x, y, i % 2 = 1 AS turned, i % 7 AS shape FROM (SELECT doc, page, x, y, row_number() OVER (PARTITION BY doc, page ORDER BY x, y) AS i FROM dots) d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) z WHERE k = 0 OR i % 3 = 0""",
    "diags": """
SELECT doc, page, CAST((i * 2 + k) * 4 + n AS BIGINT) AS diag_id, CASE WHEN turned THEN x + v1 ELSE x + u1 END AS x1, CASE WHEN turned THEN y + u1 ELSE y + v1 END AS y1, CASE WHEN turned THEN x + v2 ELSE x + u2 END AS x2, CASE WHEN turned THEN y + u2 ELSE y + v2 END AS y2
FROM (SELECT *, 0 AS n, 0.0 AS u1, 8.0 * k AS v1, 4.0 AS u2, 8.0 * k - 4 AS v2 FROM ports UNION ALL SELECT *, 1, 4.0, 8.0 * k + 4, 0.0, 8.0 * k FROM ports
  UNION ALL SELECT *, 2, 24.0, 8.0 * k - 4, 28.0, 8.0 * k FROM ports WHERE shape = 3 UNION ALL SELECT *, 3, 28.0, 8.0 * k, 24.0, 8.0 * k + 4 FROM ports WHERE shape = 3) t""",
    "edges": """
SELECT doc, page, CAST((i * 2 + k) * 8 + n AS BIGINT) AS seg_id, CASE WHEN turned THEN x + v1 ELSE x + u1 END AS x1, CASE WHEN turned THEN y + u1 ELSE y + v1 END AS y1, CASE WHEN turned THEN x + v2 ELSE x + u2 END AS x2, CASE WHEN turned THEN y + u2 ELSE y + v2 END AS y2, glyph
FROM (SELECT *, 0 AS n, 4.0 AS u1, 8.0 * k - 4 AS v1, 24.0 AS u2, 8.0 * k - 4 AS v2, false AS glyph FROM ports UNION ALL SELECT *, 1, 24.0, 8.0 * k + 4, 4.0, 8.0 * k + 4, false FROM ports UNION ALL SELECT *, 4, -10.0, 8.0 * k, 0.0, 8.0 * k, false FROM ports
  UNION ALL SELECT *, 2, 24.0, 8.0 * k - 4, 24.0, 8.0 * k + 4, shape = 2 FROM ports WHERE shape IN (0, 2) UNION ALL SELECT *, 2, 24.0, 8.0 * k - 4, 24.0, 8.0 * k, false FROM ports WHERE shape IN (1, 5)
  UNION ALL SELECT *, 3, 24.0, 8.0 * k + 4, 24.0, 8.0 * k, false FROM ports WHERE shape = 1 UNION ALL SELECT *, 2, 24.0, 8.0 * k - 4, 24.0, 8.0 * k - 1, false FROM ports WHERE shape = 6 UNION ALL SELECT *, 3, 24.0, 8.0 * k - 1, 24.0, 8.0 * k + 3.5, true FROM ports WHERE shape = 6) t""",
    # bodies of four lines: some share an edge with the next, some lack one, some have a corner a hair apart
    "frames": """
SELECT doc, page, CAST((i * 8 + (i * 3 + n) % 8) AS BIGINT) AS seg_id, x1, y1, x2, y2
FROM (SELECT doc, page, i, n, CASE n WHEN 1 THEN x + w WHEN 5 THEN x + w ELSE x END AS x1, CASE n WHEN 0 THEN y WHEN 1 THEN y WHEN 3 THEN y + h WHEN 2 THEN y + h WHEN 6 THEN y + 2 * h ELSE y + h END AS y1,
    CASE n WHEN 3 THEN x WHEN 4 THEN x ELSE x + w + CASE WHEN i % 6 = 2 AND n = 2 THEN 0.125 ELSE 0 END END AS x2, CASE n WHEN 0 THEN y WHEN 1 THEN y + h WHEN 3 THEN y WHEN 2 THEN y + h ELSE y + 2 * h END AS y2
  FROM (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY x, y) AS i, x - 5 AS x, y - 10 AS y, CASE WHEN (x + y) % 70 = 20 THEN 10.0 ELSE 20.0 + x % 30 END AS w, CASE WHEN (x + y) % 70 = 20 THEN 10.0 ELSE 20.0 END AS h FROM dots) d
    CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 AS n UNION ALL SELECT 2 AS n UNION ALL SELECT 3 AS n UNION ALL SELECT 4 AS n UNION ALL SELECT 5 AS n UNION ALL SELECT 6 AS n) m WHERE (n < 4 OR i % 4 = 1) AND NOT (n = 2 AND i % 5 = 4)) f""",
    # references and values with pens, some turned, some in bodies; strokes of symbols, on some lines between the two
    "part_texts": """
SELECT doc, page, text_id, str, kind, x0, y0, x1, y1, ax, ay, size, CASE WHEN text_id % 22 = 7 THEN -90 ELSE rot END AS rot, CASE WHEN text_id % 10 = 4 THEN CAST(NULL AS STRING) WHEN text_id % 14 = 3 THEN '#00a000' ELSE '#f00000' END AS color, in_body OR text_id % 26 = 5 AS in_body, net_id FROM fields""",
    "part_boxes": """
SELECT doc, page, CAST(i AS BIGINT) AS box_id, x + 11 AS x0, y - 3 AS y0, x + 18 AS x1, y AS y1 FROM parts WHERE page % 3 <> 2""",
    # a bookmark tree: nets with pins, parts with pins, a second Nets that does not count, a net of that name, a part that comes twice, drawings without nets
    "bookmarks": """
SELECT doc, page * 1000000 + node AS node, CASE WHEN parent IS NOT NULL THEN page * 1000000 + parent END AS parent, title, CASE WHEN node = 0 THEN page END AS page FROM (
  SELECT DISTINCT doc, page, 0 AS node, CAST(NULL AS BIGINT) AS parent, 'Sheet' AS title FROM pins UNION ALL SELECT DISTINCT doc, page, 1, 0, 'Nets (6)' FROM pins UNION ALL SELECT DISTINCT doc, page, 10000, 0, 'Components' FROM pins
  UNION ALL SELECT DISTINCT doc, page, 1000 * (1 + CAST(substring(gt, 2) AS BIGINT)), 1, gt FROM pins UNION ALL SELECT DISTINCT doc, page, 1000 * (1 + CAST(substring(gt, 2) AS BIGINT)) + 1, 1000 * (1 + CAST(substring(gt, 2) AS BIGINT)), 'Pins (9)' FROM pins WHERE doc % 4 <> 3
  UNION ALL SELECT doc, page, 1000 * (1 + CAST(substring(gt, 2) AS BIGINT)) + 2 + CAST(substring(split_part(pin, '-', 1), 2) AS BIGINT) * 40 + CAST(split_part(pin, '-', 2) AS BIGINT), 1000 * (1 + CAST(substring(gt, 2) AS BIGINT)) + 1, ' ' || pin || ' ' FROM pins WHERE doc % 4 <> 3
  UNION ALL SELECT DISTINCT doc, page, 9000, 1, 'Nets' FROM pins UNION ALL SELECT DISTINCT doc, page, 9001, 9000, 'Pins' FROM pins WHERE doc % 4 <> 3 UNION ALL SELECT DISTINCT doc, page, 9002, 9001, 'X-1' FROM pins WHERE doc % 4 <> 3
  UNION ALL SELECT DISTINCT doc, page, 10000 + 100 * (1 + CAST(substring(split_part(pin, '-', 1), 2) AS BIGINT)), 10000, split_part(pin, '-', 1) FROM pins
  UNION ALL SELECT doc, page, 10000 + 100 * (1 + CAST(substring(split_part(pin, '-', 1), 2) AS BIGINT)) + 1 + CAST(split_part(pin, '-', 2) AS BIGINT), 10000 + 100 * (1 + CAST(substring(split_part(pin, '-', 1), 2) AS BIGINT)), pin FROM pins
  UNION ALL SELECT DISTINCT doc, page, 20000, 10000, 'U1' FROM pins WHERE page % 2 = 1 UNION ALL SELECT DISTINCT doc, page, 20001, 20000, 'U1:EP' FROM pins WHERE page % 2 = 1
  UNION ALL SELECT DISTINCT doc, page, 90000, 0, 'Nets' FROM pins UNION ALL SELECT DISTINCT doc, page, 90001, 90000, 'FAKE' FROM pins UNION ALL SELECT DISTINCT doc, page, 90002, 90001, 'Pins' FROM pins UNION ALL SELECT DISTINCT doc, page, 90003, 90002, 'F-1' FROM pins) b""",
}
#: Which fixtures a fixture is made of.
NEEDS = {"texts": ["segs"], "gt_wires": ["segs"], "marks": ["dots"], "fields": ["parts"], "heights": ["dots"], "bars": ["dots", "marks"], "prims": ["segs"], "pin_boxes": ["parts"], "lettered": ["segs", "texts", "parts"], "part_links": ["parts"], "net_links": ["segs", "texts"], "sheet_texts": ["segs", "texts", "parts", "fields"], "ports": ["dots"], "diags": ["dots", "ports"], "edges": ["dots", "ports"], "frames": ["dots"], "part_texts": ["parts", "fields"], "part_boxes": ["parts"], "bookmarks": ["pins"], **{t: ["segs", "texts"] for t in ("strokes", "links", "flags")}}

#: Tables read from the given ones, which others are made of.
DEALT = {"segs", "dots", "parts"}


def dealt_segs(lineitem: DataFrame) -> DataFrame:
    """The rows of SQL["segs"], shuffled once: lines are dealt by their page as they are read, and equal ones are merged and all are numbered in place, in one order. That SQL shuffles all lines by their keys, then by their sheet."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sheet = F.floor(F.col("l_orderkey") / 150)
    page = [F.floor(sheet / 5), sheet % 5]
    lines = by_page(lineitem.select(*key, F.col("l_quantity").cast("long").alias("quantity"), "l_returnflag", "l_linestatus"), page)
    g = lines.groupBy(page[0].alias("doc"), page[1].alias("page"), *key).agg(F.min("quantity").alias("quantity"), F.concat(F.min("l_returnflag"), F.min("l_linestatus")).alias("style"))
    at = lambda n: (n % 60 * 10).cast("double")
    x, y, length, level = at(F.col("l_partkey") * 31 + F.col("l_linenumber") * 7), at(F.col("l_suppkey") * 17 + F.col("l_orderkey") * 3), (10 * (1 + F.col("quantity") % 6)).cast("double"), F.col("l_linenumber") % 2 == 0
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy(*key))
    return g.select("doc", "page", (n - 1).cast("long").alias("seg_id"), x.alias("x1"), y.alias("y1"), F.when(level, x + length).otherwise(x).alias("x2"), F.when(level, y).otherwise(y + length).alias("y2"),
                    F.when(F.col("l_partkey") % 5 < 3, "AF").otherwise(F.col("style")).alias("style"), ((F.col("quantity") % 4).cast("double") / 4 + 0.25).alias("width"))


def table(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table, or one derived from given tables; those that others are made of are dealt by page. ``made``: tables that are there already."""
    if made and name in made:
        return made[name]
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "segs":
        return by_page(dealt_segs(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
    sql = SQL[name]
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders") if "{" + t + "}" in sql}
    for t in NEEDS.get(name, []):
        inputs[t] = table(spark, sf_dir, t, made)
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    out = spark.sql(sql, **inputs)
    return by_page(out) if name in DEALT else out


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Several tables at once, for operators that read them more than once: what they are made of is persisted as dealt, and read from there instead of being made for every reader.
    That comes last, as the views that SQL reads a table by are dropped after it, and what is persisted under them with them."""
    made = {t: table(spark, sf_dir, t) for t in sorted({x for n in names for x in [*NEEDS.get(n, []), n]} & DEALT)}
    out = [table(spark, sf_dir, n, made) for n in names]
    for base in made.values():
        base.persist()
    return out


def with_ctes(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` (which starts with further CTEs as "name AS (...), ... SELECT" or with SELECT) over the named fixtures."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = ", ".join(f"{n} AS ({SQL[n].replace('{lineitem}', 'lineitem').replace('{orders}', 'orders')})" for n in order)
    body = body.strip()
    return f"WITH RECURSIVE {ctes}{',' if not body.upper().startswith('SELECT') else ''} {body}" if ctes else body
