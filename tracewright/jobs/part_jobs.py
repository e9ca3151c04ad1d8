"""Queries on parts, their values and bills of materials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_rules import CONNECTOR, STANDARD_REF, classify_text, csv_cell, gate_base, natural_key
from ..operators.spatial import grid_join, point_box
from ..sources.fixtures import table, with_ctes
from .oracle import natural, q

RADIUS = 28.0


def _refs(spark, sf):
    return table(spark, sf, "parts").select("doc", "page", "ref", "i", "x", "y")


def _values(spark, sf):
    v = table(spark, sf, "parts").where("value is not null")
    return v.select("doc", "page", F.col("i").alias("vid"), "value", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def _pairs(spark, sf):
    """Candidate values of each reference within RADIUS across and 21 down, with their cost: distance, and half of it again off the axes."""
    near = lambda l, r: (F.abs(l["x"] - r["x"]) <= RADIUS) & (F.abs(l["y"] - r["y"]) <= 21)  # noqa: E731, E741
    j = grid_join(_refs(spark, sf), _values(spark, sf), ["doc", "page"], point_box(grow=RADIUS), point_box(), 40.0, near)
    dx, dy = F.abs(F.col("l.x") - F.col("r.x")), F.abs(F.col("l.y") - F.col("r.y"))
    return j.select("l.doc", "l.page", "l.ref", "l.i", "r.vid", "r.value", (F.sqrt(dx * dx + dy * dy) + 0.5 * F.least(dx, dy)).alias("cost"))


def value_candidates(spark, sf):
    return _pairs(spark, sf).select("doc", "page", "i", "vid", F.round("cost", 6).alias("cost"))


def value_mutual_nearest(spark, sf):
    """References and values that are each other's nearest; ties go to the lower number."""
    p = _pairs(spark, sf)
    a = p.groupBy("doc", "page", "i").agg(F.min(F.struct(F.round("cost", 6).alias("c"), "vid")).alias("b")).select("doc", "page", "i", "b.vid")
    b = p.groupBy("doc", "page", "vid").agg(F.min(F.struct(F.round("cost", 6).alias("c"), "i")).alias("b")).select("doc", "page", "vid", "b.i")
    return a.join(b, ["doc", "page", "i", "vid"])


def _paired(spark, sf):
    t = table(spark, sf, "parts")
    m = value_mutual_nearest(spark, sf).join(t.select("doc", "page", F.col("i").alias("vid"), "value"), ["doc", "page", "vid"])
    return t.select("doc", "page", "ref", "i").join(m.select("doc", "page", "i", "value"), ["doc", "page", "i"], "left")


def components_build(spark, sf):
    return _paired(spark, sf).select("doc", "page", "ref", "value")


def comp_entries(spark, sf):
    """Per drawing and reference: its distinct values in the order of pages, and its pages."""
    p = _paired(spark, sf)
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("doc", "page", "i", "value")))), lambda x: x["value"])
    pages = F.transform(F.array_sort(F.collect_set(F.col("page") + 1)), lambda x: x.cast("string"))
    return p.groupBy("doc", "ref").agg(F.array_join(F.array_distinct(seen), " / ").alias("values"), F.array_join(pages, " ").alias("pages"), F.count("*").alias("places"))


def comp_list_sort(spark, sf):
    return comp_entries(spark, sf).select("doc", "ref", F.row_number().over(Window.partitionBy("doc").orderBy(natural_key(F.col("ref")), "ref")).alias("place"))


def sink_parts_csv(spark, sf):
    return comp_entries(spark, sf).select("doc", F.concat_ws(",", csv_cell(F.col("ref")), csv_cell(F.col("values")), csv_cell(F.col("pages"))).alias("line"))


def bom_group(spark, sf):
    """Equal values of a drawing with their references."""
    p = _paired(spark, sf).where("value is not null").select("doc", "value", "ref").distinct()
    return p.groupBy("doc", "value").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("ref")), ",").alias("refs"))


def bom_reconcile(spark, sf):
    """The drawing's parts against a bill of materials: equal, different, only here, only there."""
    here = _paired(spark, sf).groupBy("doc", "page", "ref").agg(F.min("value").alias("value"))
    bom = table(spark, sf, "parts").where("i % 7 <> 3").select("doc", "page", F.when(F.col("i") % 11 == 5, F.concat("ref", F.lit("X"))).otherwise(F.col("ref")).alias("ref"), F.when(F.col("i") % 5 == 2, F.lit("DNP")).otherwise(F.col("value")).alias("wanted"))
    j = here.withColumn("here", F.lit(True)).join(bom.withColumn("there", F.lit(True)), ["doc", "page", "ref"], "full_outer")
    status = F.when(F.col("there").isNull(), "only_drawing").when(F.col("here").isNull(), "only_bom").when(F.col("value").eqNullSafe(F.col("wanted")), "equal").otherwise("different")
    return j.select("doc", "page", "ref", status.alias("status"), "value", "wanted")


def multi_gate_refs(spark, sf):
    """Units of one part: the suffix goes if two units share the base or the base occurs itself."""
    s = table(spark, sf, "strings").select((F.col("k") % 3).alias("doc"), (F.col("k") % 97).alias("page"), "str").distinct()
    c = s.where(classify_text(F.col("str")) == "component").withColumn("base", gate_base(F.col("str")))
    many = c.where("base is not null").groupBy("doc", "page", "base").agg(F.count("*").alias("n"))
    j = c.join(many, ["doc", "page", "base"], "left").join(s.select("doc", "page", F.col("str").alias("base"), F.lit(True).alias("whole")), ["doc", "page", "base"], "left")
    plain = F.regexp_replace("str", r"^\*", "")
    return j.select("doc", "page", "str", F.when((F.col("n") > 1) | F.col("whole"), F.col("base")).otherwise(plain).alias("part"))


def odd_reference_style(spark, sf):
    """References of another style become values where they are at most one in twelve of a page."""
    s = table(spark, sf, "strings").select((F.col("k") % 3).alias("doc"), (F.col("k") % 53).alias("page"), "k", "str").where(classify_text(F.col("str")) == "component")
    s = s.withColumn("odd", ~(F.col("str").rlike(STANDARD_REF) | F.col("str").rlike(CONNECTOR) | F.col("str").startswith("*")))
    w = Window.partitionBy("doc", "page")
    few = F.sum(F.col("odd").cast("long")).over(w) * 12 <= F.count("*").over(w)
    return s.select("doc", "page", "k", F.when(F.col("odd") & few, "value").otherwise("component").alias("kind"))


def offset_repeat(spark, sf):
    """How many parts of a kind have a candidate value at the same offset."""
    near = lambda l, r: (F.abs(l["x"] - r["x"]) <= RADIUS) & (F.abs(l["y"] - r["y"]) <= 21)  # noqa: E731, E741
    j = grid_join(_refs(spark, sf), _values(spark, sf), ["doc", "page"], point_box(grow=RADIUS), point_box(), 40.0, near)
    r = lambda c: F.floor(c + 0.5).cast("long")
    j = j.select("l.doc", "l.page", F.substring("l.ref", 1, 1).alias("prefix"), "l.i", r(F.col("r.x") - F.col("l.x")).alias("dx"), r(F.col("r.y") - F.col("l.y")).alias("dy"))
    return j.groupBy("doc", "page", "prefix", "dx", "dy").agg(F.count_distinct("i").alias("parts"))


_V = "vals AS (SELECT doc, page, i AS vid, value, x + dx AS x, y + dy AS y FROM parts WHERE value IS NOT NULL)"
_P = f"""{_V}, pairs AS (SELECT r.doc, r.page, r.ref, r.i, v.vid, v.value, round(sqrt((r.x-v.x)*(r.x-v.x)+(r.y-v.y)*(r.y-v.y)) + 0.5 * least(abs(r.x-v.x), abs(r.y-v.y)), 6) AS cost FROM parts r JOIN vals v ON r.doc = v.doc AND r.page = v.page AND abs(r.x - v.x) <= 28 AND abs(r.y - v.y) <= 21)"""
_M = f"""{_P}, a AS (SELECT doc, page, i, vid FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, i ORDER BY cost, vid) AS r FROM pairs) z WHERE r = 1),
b AS (SELECT doc, page, i, vid FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, vid ORDER BY cost, i) AS r FROM pairs) z WHERE r = 1),
mutual AS (SELECT a.doc, a.page, a.i, a.vid FROM a JOIN b ON a.doc = b.doc AND a.page = b.page AND a.i = b.i AND a.vid = b.vid)"""
_D = f"{_M}, paired AS (SELECT p.doc, p.page, p.ref, p.i, v.value FROM parts p LEFT JOIN mutual m ON p.doc = m.doc AND p.page = m.page AND p.i = m.i LEFT JOIN parts v ON v.doc = m.doc AND v.page = m.page AND v.i = m.vid)"
_C = f"""{_D}, firsts AS (SELECT doc, ref, value, min(page * 100000 + i) AS o FROM paired WHERE value IS NOT NULL GROUP BY doc, ref, value),
vs AS (SELECT doc, ref, string_agg(value, ' / ' ORDER BY o) AS values FROM firsts GROUP BY doc, ref),
entries AS (SELECT p.doc, p.ref, coalesce(any_value(v.values), '') AS values, array_to_string(list_sort(list(DISTINCT p.page + 1)), ' ') AS pages, count(*) AS places FROM paired p LEFT JOIN vs v ON p.doc = v.doc AND p.ref = v.ref GROUP BY p.doc, p.ref)"""



def _kinds_sql() -> str:
    from .scalar_jobs import kinds

    return kinds("s")


JOBS = {
    "value_candidates": (value_candidates, with_ctes(f"{_P} SELECT doc, page, i, vid, cost FROM pairs", "parts")),
    "value_mutual_nearest": (value_mutual_nearest, with_ctes(f"{_M} SELECT doc, page, i, vid FROM mutual", "parts")),
    "components_build": (components_build, with_ctes(f"{_D} SELECT doc, page, ref, value FROM paired", "parts")),
    "comp_entries": (comp_entries, with_ctes(f"{_C} SELECT doc, ref, values, pages, places FROM entries", "parts")),
    "comp_list_sort": (comp_list_sort, with_ctes(f"{_C} SELECT doc, ref, row_number() OVER (PARTITION BY doc ORDER BY {natural('ref')}, ref) AS place FROM entries", "parts")),
    "sink_parts_csv": (sink_parts_csv, with_ctes(f"{_C} SELECT doc, ref || ',' || values || ',' || pages AS line FROM entries", "parts")),
    "bom_group": (bom_group, with_ctes(f"{_D} SELECT doc, value, count(*) AS n, string_agg(ref, ',' ORDER BY ref) AS refs FROM (SELECT DISTINCT doc, value, ref FROM paired WHERE value IS NOT NULL) z GROUP BY doc, value", "parts")),
    "bom_reconcile": (bom_reconcile, with_ctes(f"""{_D}, here AS (SELECT doc, page, ref, min(value) AS value FROM paired GROUP BY doc, page, ref), bom AS (SELECT doc, page, CASE WHEN i % 11 = 5 THEN ref || 'X' ELSE ref END AS ref, CASE WHEN i % 5 = 2 THEN 'DNP' ELSE value END AS wanted FROM parts WHERE i % 7 <> 3)
SELECT coalesce(h.doc, b.doc) AS doc, coalesce(h.page, b.page) AS page, coalesce(h.ref, b.ref) AS ref, CASE WHEN b.page IS NULL THEN 'only_drawing' WHEN h.page IS NULL THEN 'only_bom' WHEN value IS NOT DISTINCT FROM wanted THEN 'equal' ELSE 'different' END AS status, value, wanted FROM here h FULL JOIN bom b ON h.doc = b.doc AND h.page = b.page AND h.ref = b.ref""", "parts")),
    "multi_gate_refs": (multi_gate_refs, with_ctes(f"""s0 AS (SELECT DISTINCT k % 3 AS doc, k % 97 AS page, str, trim(str) AS s FROM strings), c AS (SELECT doc, page, str, CASE WHEN regexp_matches(ltrim(str, '*'), '^[A-Z]+\\d{{1,4}}[A-H]$') THEN left(ltrim(str, '*'), -1) END AS base FROM s0 WHERE ({_kinds_sql()}) = 'component'),
m AS (SELECT doc, page, base, count(*) AS n FROM c WHERE base IS NOT NULL GROUP BY doc, page, base)
SELECT c.doc, c.page, c.str, CASE WHEN m.n > 1 OR w.str IS NOT NULL THEN c.base ELSE regexp_replace(c.str, '^\\*', '') END AS part FROM c LEFT JOIN m ON c.doc = m.doc AND c.page = m.page AND c.base = m.base LEFT JOIN s0 w ON w.doc = c.doc AND w.page = c.page AND w.str = c.base""", "strings")),
    "odd_reference_style": (odd_reference_style, with_ctes(f"""c AS (SELECT doc, page, k, NOT (regexp_matches(str, {q(STANDARD_REF)}) OR regexp_matches(str, {q(CONNECTOR)}) OR starts_with(str, '*')) AS odd FROM (SELECT k % 3 AS doc, k % 53 AS page, k, str, trim(str) AS s FROM strings) z WHERE ({_kinds_sql()}) = 'component')
SELECT doc, page, k, CASE WHEN odd AND sum(CASE WHEN odd THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page) * 12 <= count(*) OVER (PARTITION BY doc, page) THEN 'value' ELSE 'component' END AS kind FROM c""", "strings")),
    "offset_repeat": (offset_repeat, with_ctes(f"{_V} SELECT r.doc, r.page, left(r.ref, 1) AS prefix, CAST(floor(v.x - r.x + 0.5) AS BIGINT) AS dx, CAST(floor(v.y - r.y + 0.5) AS BIGINT) AS dy, count(DISTINCT r.i) AS parts FROM parts r JOIN vals v ON r.doc = v.doc AND r.page = v.page AND abs(r.x - v.x) <= 28 AND abs(r.y - v.y) <= 21 GROUP BY ALL", "parts")),
}
