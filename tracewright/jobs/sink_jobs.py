"""Queries that write files and read them back, and statistics of styles on true wires."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nets, scores
from ..operators import primitives as P
from ..sources import sinks, truth
from ..sources.fixtures import table, with_ctes
from ..sources.shared import shared_path
from . import net_jobs, part_jobs
from . import oracle as O
from .oracle import natural, q

BOM_SQL = "chr(65279)"


def _drawings(spark, sf):
    return table(spark, sf, "dots").select("doc").distinct()


def _hashed(spark, rows, cells, header, drawings):
    path = shared_path(spark, "csv")
    sinks.write_csv(rows, cells, header, drawings, path)
    return sinks.written_files(spark, path).select("doc", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def nets_csv_files(spark, sf):
    """The nets CSV of each drawing, byte for byte."""
    return _hashed(spark, nets.net_list_order(net_jobs.net_entries(spark, sf)), ["net", "type", "labels", "pages"], ["net", "type", "labels", "pages"], _drawings(spark, sf))


def _parts(spark, sf):
    e = part_jobs.comp_entries(spark, sf)
    return e.join(part_jobs.comp_list_sort(spark, sf), ["doc", "ref"])


def parts_csv_files(spark, sf):
    """The parts CSV of each drawing, byte for byte."""
    return _hashed(spark, _parts(spark, sf), ["ref", "values", "pages"], ["reference", "value", "pages"], _drawings(spark, sf))


def report_json(spark, sf):
    """The report of each drawing, written as JSON lines and read back."""
    n = nets.net_list_order(net_jobs.net_entries(spark, sf))
    p = _parts(spark, sf).withColumn("values", F.filter(F.split("values", " / "), lambda v: v != ""))
    d = _drawings(spark, sf).withColumn("file", F.concat(F.lit("drawing-"), F.col("doc"), F.lit(".pdf")))
    path = shared_path(spark, "reports")
    sinks.write_reports(sinks.reports(d, n, p), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.file").alias("file"), F.col("value").alias("report"))


def ground_bars(spark, sf):
    return P.ground_bars(table(spark, sf, "bars"), 5.0).select("doc", "page", "level", "first", "n", "shrinks", "centre", "top")


def ground_wires(spark, sf):
    """Wires at the stems of ground symbols."""
    return P.ground_wires(P.ground_bars(table(spark, sf, "bars"), 5.0), table(spark, sf, "segs"), 5.0).select("doc", "page", "level", "first", "seg_id").distinct()


def style_wire_stats(spark, sf):
    """Strokes against true wires that lie at half the scale, moved by (20, -15), where page 4 of a drawing has no fit."""
    g = table(spark, sf, "gt_wires").select("doc", "page", *[((F.col(c) - (40 if c[0] == "x" else -30)) / 2).alias(c) for c in ("x1", "y1", "x2", "y2")])
    fits = _drawings(spark, sf).select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("page"), *[F.lit(v).alias(c) for c, v in zip("abcdef", (2.0, 0.0, 0.0, 2.0, 40.0, -30.0), strict=True)])
    s = table(spark, sf, "segs").withColumns({"style": F.concat("style", F.lit("/"), F.col("width").cast("string"), F.lit("/"), (F.col("seg_id") % 3).cast("string")), "closed": F.when(F.col("seg_id") % 6 > 0, F.col("seg_id") % 4 == 1)})
    out = scores.style_wire_stats(s, g, fits)
    return out.select("doc", "page", "rank", "style", "n", *[F.round(c, 6).alias(c) for c in ("mean_len", "closed", "on_wire")])


def src_manifest(spark, sf):
    """A manifest for each drawing, written as JSON and read back with nulls where an entry leaves a field out."""
    p = table(spark, sf, "parts")
    entry = F.struct(F.concat_ws("-", F.lit("sheet"), "doc", "page", "i").alias("id"), F.when(F.col("i") % 3 > 0, "cad").otherwise("pen").alias("tool"), F.concat("ref", F.lit(".pdf")).alias("pdf"), F.when(F.col("i") % 3 > 0, F.concat("ref", F.lit(".kicad_sch"))).alias("source"), F.when(F.col("i") % 4 == 0, True).alias("local"), F.when(F.col("i") % 5 == 0, F.col("page")).cast("int").alias("sheet"), F.col("value").alias("note"))
    m = p.groupBy("doc").agg(F.to_json(F.struct(F.lit("drawings").alias("about"), F.sort_array(F.collect_list(entry)).alias("entries"))).alias("value"))
    path = shared_path(spark, "manifests")
    m.write.partitionBy("doc").text(path)
    return truth.read_manifest(spark, path).select("id", "tool", "repo", "pdf", "source", "local", "sheet", "note")


_CELL = lambda s: f"CASE WHEN regexp_matches({s}, '^[=+\\-@]') THEN '\"=\"\"' || replace({s}, '\"', '\"\"\"\"') || '\"\"\"' WHEN regexp_matches({s}, '[\",\\r\\n]') THEN '\"' || replace({s}, '\"', '\"\"') || '\"' ELSE {s} END"
_FILE = lambda header, lines: f"files AS (SELECT d.doc, {BOM_SQL} || {q(header)} || chr(13) || chr(10) || coalesce(string_agg(line || chr(13) || chr(10), '' ORDER BY place) FILTER (line IS NOT NULL), '') AS f FROM (SELECT DISTINCT doc FROM dots) d LEFT JOIN ({lines}) l USING (doc) GROUP BY d.doc) SELECT doc, CAST(strlen(f) AS BIGINT) AS n_bytes, sha256(f) AS sha256 FROM files"
_NETS_LIST = f"SELECT doc, {net_jobs._ORDER} AS place, net, type, labels, pages FROM entries"
_PARTS_LIST = f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY {natural('ref')}, ref) AS place, ref, values, pages FROM part_entries"
_C = part_jobs._C.replace("entries AS (", "part_entries AS (")
_PAGES = "list_transform(string_split(pages, ' '), lambda p: CAST(p AS BIGINT))"
_RUN = """b AS (SELECT *, floor(centre / 0.75 + 0.5) AS lane, row_number() OVER (PARTITION BY doc, page, level, floor(centre / 0.75 + 0.5) ORDER BY pos, len) AS i, pos - lag(pos) OVER (PARTITION BY doc, page, level, floor(centre / 0.75 + 0.5) ORDER BY pos, len) AS gap FROM bars),
ch AS (SELECT *, sum(CASE WHEN gap BETWEEN 0.4 AND 4 THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page, level, lane ORDER BY i) AS chain FROM b),
li AS (SELECT doc, page, level, lane, chain, list(len ORDER BY i) AS l, list(pos ORDER BY i) AS p, list(centre ORDER BY i) AS c FROM ch GROUP BY doc, page, level, lane, chain HAVING count(*) >= 3),
st AS (SELECT *, list_filter(range(1, len(l) - 1), lambda i: len(list_filter(range(i, len(l)), lambda k: l[k + 1] >= l[k] - 0.05)) = 0)[1] AS dec, list_filter(range(1, len(l) - 1), lambda i: len(list_filter(range(i, len(l)), lambda k: l[k + 1] <= l[k] + 0.05)) = 0)[1] AS inc FROM li),
stacks AS MATERIALIZED (SELECT doc, page, level, lane, p[coalesce(dec, inc)] AS first, len(l) - coalesce(dec, inc) + 1 AS n, dec IS NOT NULL AS shrinks, CASE WHEN dec IS NOT NULL THEN c[dec] ELSE c[len(l)] END AS centre, CASE WHEN dec IS NOT NULL THEN p[dec] ELSE p[len(l)] END AS top FROM st WHERE coalesce(dec, inc) IS NOT NULL)"""

JOBS = {
    "src_manifest": (src_manifest, with_ctes("SELECT 'sheet-' || doc || '-' || page || '-' || i AS id, CASE WHEN i % 3 > 0 THEN 'cad' ELSE 'pen' END AS tool, CAST(NULL AS VARCHAR) AS repo, ref || '.pdf' AS pdf, CASE WHEN i % 3 > 0 THEN ref || '.kicad_sch' END AS source, CASE WHEN i % 4 = 0 THEN true END AS local, CAST(CASE WHEN i % 5 = 0 THEN page END AS INTEGER) AS sheet, value AS note FROM parts", "parts")),
    "nets_csv_files": (nets_csv_files, with_ctes(f"{O.NETS}, {O.ENTRIES}, " + _FILE("net,type,labels,pages", f"SELECT doc, place, {_CELL('net')} || ',' || type || ',' || labels || ',' || pages AS line FROM ({_NETS_LIST}) e"), "segs", "dots", "texts")),
    "parts_csv_files": (parts_csv_files, with_ctes(f"{_C}, " + _FILE("reference,value,pages", f"SELECT doc, place, {_CELL('ref')} || ',' || {_CELL('values')} || ',' || pages AS line FROM ({_PARTS_LIST}) e"), "dots", "parts")),
    "report_json": (report_json, with_ctes(f"""{O.NETS}, {O.ENTRIES}, {_C}, n AS (SELECT doc, list(struct_pack(name := net, power := type = 'power', labelCount := labels, pages := {_PAGES}) ORDER BY place) AS nets FROM ({_NETS_LIST}) e GROUP BY doc),
p AS (SELECT doc, list(struct_pack(ref := ref, values := CASE WHEN values = '' THEN [] ELSE string_split(values, ' / ') END, pages := {_PAGES}) ORDER BY place) AS components FROM ({_PARTS_LIST}) e GROUP BY doc),
r AS (SELECT 'drawing-' || d.doc || '.pdf' AS file, coalesce(n.nets, []) AS nets, coalesce(p.components, []) AS components FROM (SELECT DISTINCT doc FROM dots) d LEFT JOIN n USING (doc) LEFT JOIN p USING (doc))
SELECT file, CAST(to_json(struct_pack(file := file, nets := nets, components := components)) AS VARCHAR) AS report FROM r""", "segs", "dots", "texts", "parts")),
    "ground_bars": (ground_bars, with_ctes(f"{_RUN} SELECT doc, page, level, first, n, shrinks, centre, top FROM stacks", "bars")),
    "ground_wires": (ground_wires, with_ctes(f"""{_RUN}, at AS (SELECT *, CASE WHEN level THEN centre ELSE top END AS px, CASE WHEN level THEN top ELSE centre END AS py, CASE WHEN shrinks THEN -1 ELSE 1 END AS dir FROM stacks), {O.ENDS},
c AS (SELECT a.doc, a.page, a.level, a.lane, a.first, e.seg_id, CASE WHEN level THEN e.y - py ELSE e.x - px END * dir AS d FROM at a JOIN ends e ON a.doc = e.doc AND a.page = e.page AND CASE WHEN level THEN abs(e.x - px) ELSE abs(e.y - py) END <= 1.125)
SELECT DISTINCT doc, page, level, first, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, level, lane, first ORDER BY d, seg_id) AS r FROM c WHERE d >= -0.75 AND d <= 8) z WHERE r = 1""".replace("at AS (", "places AS (").replace("FROM at a", "FROM places a"), "segs", "bars")),
    "style_wire_stats": (style_wire_stats, with_ctes("""s AS (SELECT *, style || '/' || width || '/' || (seg_id % 3) AS st, seg_id % 6 > 0 AND seg_id % 4 = 1 AS shut, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM segs WHERE page < 4),
hit AS (SELECT DISTINCT s.doc, s.page, s.seg_id FROM s JOIN gt_wires w ON s.doc = w.doc AND s.page = w.page AND (CASE WHEN w.y1 = w.y2 THEN greatest(abs(s.y1 - w.y1), abs(s.y2 - w.y1)) < 0.8 AND (s.x1 + s.x2) / 2 - w.x1 > -0.05 * (w.x2 - w.x1) AND (s.x1 + s.x2) / 2 - w.x1 < 1.05 * (w.x2 - w.x1)
  ELSE greatest(abs(s.x1 - w.x1), abs(s.x2 - w.x1)) < 0.8 AND (s.y1 + s.y2) / 2 - w.y1 > -0.05 * (w.y2 - w.y1) AND (s.y1 + s.y2) / 2 - w.y1 < 1.05 * (w.y2 - w.y1) END)),
g AS (SELECT s.doc, s.page, st, count(*) AS n, sum(len) AS len, count(*) FILTER (shut) AS shut, coalesce(sum(len) FILTER (h.seg_id IS NOT NULL), 0) AS wire FROM s LEFT JOIN hit h ON s.doc = h.doc AND s.page = h.page AND s.seg_id = h.seg_id GROUP BY s.doc, s.page, st)
SELECT doc, page, CAST(r AS INTEGER) AS rank, st AS style, n, round(len / n, 6) AS mean_len, round(shut / n, 6) AS closed, round(wire / len, 6) AS on_wire FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY len DESC, st) AS r FROM g) z WHERE r <= 10""", "segs", "gt_wires")),
}
