"""Queries on the values of parts: full costs, the steps that deal values out, and the parts they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import part_values as V
from ..operators import symbols as S
from ..sources.fixtures import tables, with_ctes
from .label_jobs import _PE, _PU
from .oracle import gap, power


def _inputs(spark, sf):
    """References, texts, heights, pin lines, pens of part fields, symbols of texts and the strokes they are made of."""
    texts, boxes, segs = tables(spark, sf, "part_texts", "part_boxes", "segs")
    refs = texts.where("kind = 'component'").select("doc", "page", "text_id", F.col("str").alias("part"))
    heights = texts.select("doc", "page").distinct().withColumn("s", F.lit(5.0))
    pens = heights.where("page % 2 = 0").select("doc", "page", F.lit("#f00000").alias("color"))
    homes = S.home_symbol(texts, boxes, S.glue_symbols(boxes, 0.25), 20.0)
    return refs, texts, heights, segs.where("seg_id % 4 = 2"), pens, homes, boxes


def value_costs(spark, sf):
    """Candidates of every reference with their full cost."""
    c = V.value_candidates(*_inputs(spark, sf))
    return c.select("doc", "page", "part", "turn", "value", F.round("gap", 6).alias("gap"), F.round("cost", 6).alias("cost"))


def value_offers(spark, sf):
    """Texts that may be values of parts."""
    _, texts, _, lines, pens, _, _ = _inputs(spark, sf)
    return V.offers(texts, lines, pens).select("doc", "page", "text_id", "plain")


def part_values(spark, sf):
    """The value of each part and the step that gave it."""
    return V.part_values(*_inputs(spark, sf))


def parts_with_values(spark, sf):
    """Parts with their texts and values."""
    i = _inputs(spark, sf)
    c = V.components(i[0], i[1], V.part_values(*i))
    return c.select("doc", "page", "ref", F.array_join(F.transform("text_ids", lambda x: x.cast("string")), " ").alias("texts"), F.array_join("values", " / ").alias("values"))


_B = lambda a: tuple(f"{a}.{c}" for c in ("x0", "y0", "x1", "y1"))
_OFFERS = f"""lines AS (SELECT * FROM segs WHERE seg_id % 4 = 2), may AS (SELECT *, kind = 'net' AS plain FROM part_texts WHERE kind = 'value' OR (kind = 'net' AND page % 2 = 0 AND color = '#f00000' AND net_id IS NULL AND NOT {power('str')})),
pu AS ({_PU.format('may').replace('JOIN segs s', 'JOIN lines s')}), pe AS ({_PE.format('may').replace('JOIN segs s', 'JOIN lines s')}),
offers AS MATERIALIZED (SELECT m.* FROM may m WHERE NOT EXISTS (SELECT 1 FROM pu WHERE pu.doc = m.doc AND pu.page = m.page AND pu.text_id = m.text_id AND cover > 0.5) AND NOT (plain AND EXISTS (SELECT 1 FROM pe WHERE pe.doc = m.doc AND pe.page = m.page AND pe.text_id = m.text_id)))"""
_HOMES = f"""touch AS MATERIALIZED (SELECT a.doc, a.page, a.box_id AS a, b.box_id AS b FROM part_boxes a JOIN part_boxes b ON a.doc = b.doc AND a.page = b.page AND a.box_id <> b.box_id AND b.x0 <= a.x1 + 0.25 AND b.x1 >= a.x0 - 0.25 AND b.y0 <= a.y1 + 0.25 AND b.y1 >= a.y0 - 0.25),
reach(doc, page, node, root) AS (SELECT doc, page, box_id, box_id FROM part_boxes UNION SELECT t.doc, t.page, t.b, r.root FROM reach r JOIN touch t ON r.doc = t.doc AND r.page = t.page AND r.node = t.a), glued AS (SELECT doc, page, node AS box_id, min(root) AS symbol FROM reach GROUP BY doc, page, node),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY d, box_id) AS r FROM (SELECT t.doc, t.page, t.text_id, s.box_id, {gap(_B('t'), _B('s'))} AS d FROM part_texts t JOIN part_boxes s ON t.doc = s.doc AND t.page = s.page WHERE t.kind NOT IN ('pin', 'note')) c WHERE d < 20) z WHERE r = 1),
homes AS MATERIALIZED (SELECT n.doc, n.page, n.text_id, g.symbol FROM n JOIN glued g ON n.doc = g.doc AND n.page = g.page AND n.box_id = g.box_id)"""
_COSTS = f"""{_OFFERS}, {_HOMES}, refs AS (SELECT *, min(text_id) OVER (PARTITION BY doc, page, str) AS part FROM part_texts WHERE kind = 'component'),
c0 AS (SELECT a.doc, a.page, a.part, a.text_id AS turn, b.text_id AS value, b.plain, a.rot = b.rot AS same_turn, a.rot = b.rot AND abs(CASE WHEN a.rot IN (0, 180, -180) THEN b.ay - a.ay ELSE b.ax - a.ax END) <= a.size * 0.25 AS line, {gap(_B('a'), _B('b'))} AS g,
  upper(regexp_extract(a.str, '^\\*?[A-Za-z]*')) || '|' || a.rot || '|' || b.rot || '|' || CAST(floor(b.ax - a.ax + 0.5) AS BIGINT) || '|' || CAST(floor(b.ay - a.ay + 0.5) AS BIGINT) AS off,
  least(abs(a.x0 + a.x1 - b.x0 - b.x1) / 2, abs(a.y0 + a.y1 - b.y0 - b.y1) / 2, abs(a.x0 - b.x0), abs(a.y1 - b.y1)) <= a.size * 0.6 AS lined,
  greatest(a.x0, b.x0) > least(a.x1, b.x1) AS wide, greatest(a.y0, b.y0) > least(a.y1, b.y1) AS high, least(a.x1, b.x1) AS lx, greatest(a.x0, b.x0) AS gx, least(a.y1, b.y1) AS ly, greatest(a.y0, b.y0) AS gy
  FROM refs a JOIN offers b ON a.doc = b.doc AND a.page = b.page AND a.text_id <> b.text_id AND NOT (b.in_body AND NOT a.in_body) AND (a.color IS NULL OR b.color IS NULL OR a.color = b.color)),
c1 AS MATERIALIZED (SELECT * FROM c0 WHERE g <= 30 AND (g <= 16 OR lined)),
thru AS (SELECT DISTINCT c.doc, c.page, c.turn, c.value FROM c1 c JOIN part_boxes m ON c.doc = m.doc AND c.page = m.page AND c.line AND CASE WHEN wide THEN gx ELSE lx END > CASE WHEN wide THEN lx ELSE gx END AND CASE WHEN high THEN gy ELSE ly END > CASE WHEN high THEN ly ELSE gy END
  AND m.x0 < CASE WHEN wide THEN gx ELSE lx END AND m.x1 > CASE WHEN wide THEN lx ELSE gx END AND m.y0 < CASE WHEN high THEN gy ELSE ly END AND m.y1 > CASE WHEN high THEN ly ELSE gy END),
often AS (SELECT doc, page, off FROM c1 GROUP BY doc, page, off HAVING count(DISTINCT part) >= 2), known AS (SELECT DISTINCT doc, page FROM homes),
c2 AS (SELECT c.*, t.turn IS NOT NULL AS through, o.off IS NOT NULL AS again, g + CASE WHEN plain THEN 7.5 ELSE 0 END + CASE WHEN same_turn THEN 0 ELSE 4.0 END + CASE WHEN k.doc IS NOT NULL AND coalesce(h1.symbol <> h2.symbol, true) THEN 15.0 ELSE 0 END AS d FROM c1 c LEFT JOIN thru t ON t.doc = c.doc AND t.page = c.page AND t.turn = c.turn AND t.value = c.value
  LEFT JOIN often o ON o.doc = c.doc AND o.page = c.page AND o.off = c.off LEFT JOIN known k ON k.doc = c.doc AND k.page = c.page LEFT JOIN homes h1 ON h1.doc = c.doc AND h1.page = c.page AND h1.text_id = c.turn LEFT JOIN homes h2 ON h2.doc = c.doc AND h2.page = c.page AND h2.text_id = c.value),
costs AS (SELECT doc, page, part, turn, value, g, greatest(CASE WHEN line THEN CASE WHEN through THEN least(d, g * 0.1) ELSE d - 7.5 END ELSE d END - CASE WHEN again THEN 7.5 ELSE 0 END, g * 0.05) AS cost FROM c2)"""
FX = ("segs", "part_texts", "part_boxes")

JOBS = {
    "value_costs": (value_costs, with_ctes(f"{_COSTS} SELECT doc, page, part, turn, value, round(g, 6) AS gap, round(cost, 6) AS cost FROM costs", *FX)),
    "value_offers": (value_offers, with_ctes(f"{_OFFERS} SELECT doc, page, text_id, plain FROM offers", "segs", "part_texts")),
    "part_values": (part_values, None),
    "parts_with_values": (parts_with_values, None),
}
