"""Queries on bookmark trees, and figures of pages, drawings, selections, searches and score sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text_rules import LOOSE_REF
from ..operators import bookmarks, pens
from ..operators import summaries as S
from ..sources.fixtures import table, with_ctes
from ..sources.shared import written
from . import evaluation_jobs as E
from . import net_jobs as N
from . import oracle as O
from .label_jobs import _PE, _PU
from .oracle import power, q
from .style_jobs import JOBS as STYLE
from .style_jobs import net_exact_naming

SEARCHES = ["sig_1", " v ", "GND", "n3", " "]


def bookmark_nets(spark, sf):
    """Nets of the bookmark tree with their pins."""
    return bookmarks.outline_nets(written(table(spark, sf, "bookmarks"), "bookmarks")).withColumn("pins", F.array_join("pins", " "))


def bookmark_parts(spark, sf):
    """Parts of the bookmark tree with their pins."""
    return bookmarks.outline_parts(written(table(spark, sf, "bookmarks"), "bookmarks")).withColumn("pins", F.array_join("pins", " "))


def loose_refs_by_pen(spark, sf):
    t, segs = table(spark, sf, "part_texts"), table(spark, sf, "segs")
    pages = t.select("doc", "page").distinct()
    return pens.loose_refs_by_pen(t, segs.where("seg_id % 4 = 2"), pages.where("page % 2 = 0").withColumn("color", F.lit("#f00000")), pages.where("page % 4 = 3").withColumn("color", F.lit("#f00000")))


def page_summary(spark, sf):
    nets, wires, made, texts = N.labelled(spark, sf)
    glyphs = made["strokes"].where("page % 2 = 0 or prim_id % 4 = 0").select("doc", "page", "prim_id")
    s = S.page_summary(made["segs"], wires, nets, made["dots"], texts, glyphs)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return s.withColumns({"kinds": kinds, "loose": F.array_join("loose", ",")})


def doc_summary(spark, sf):
    nets, _, _, made = N.drawn(spark, sf, "parts")
    return S.doc_summary(nets, made["parts"])


def net_selection(spark, sf):
    nets, wires, labels, made = N.drawn(spark, sf)
    s = S.net_selection(nets, wires, labels, N.dot_nets(wires, made))
    return s.withColumn("labels", F.array_join(F.transform("labels", lambda x: F.concat_ws(":", x["str"], x["n"].cast("string"))), ","))


def search_nets(spark, sf):
    """Nets of each drawing as listed, by name."""
    e = N.net_list_sort(spark, sf).select("doc", "place", F.array("net").alias("names"))
    return S.search(e, SEARCHES, ["doc"]).select("doc", "query", F.col("names")[0].alias("net"), "rank", "hit", "exact")


def search_parts(spark, sf):
    """Parts of each page by reference or value."""
    p = table(spark, sf, "parts").select("doc", "page", "ref", F.col("i").alias("place"), F.array_compact(F.array("ref", "value")).alias("names"))
    return S.search(p, ["1", "r1", "7k", ""], ["doc", "page"]).select("doc", "page", "query", "ref", "rank", "hit", "exact")


METRICS = ["wire_precision", "wire_recall", "group_precision", "group_recall", "net_exact", "naming", "ref_recall", "ref_precision", "value_exact"]


def score_summary(spark, sf):
    """All metrics of each page with true wires, their means and the number of phantom names."""
    key = ["doc", "page"]
    w = E.wire_precision_recall(spark, sf).withColumn("wire_precision", F.when(F.col("page") % 5 != 4, F.col("wire_precision")))
    g = E.group_precision_recall(spark, sf).withColumn("group_recall", F.when(F.col("page") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("group_recall")))
    n = net_exact_naming(spark, sf).select(*key, F.try_divide("exact", "nets").alias("net_exact"), F.try_divide("named_ok", "named").alias("naming"))
    r = E.ref_recall_precision(spark, sf).select(*key, F.col("recall").alias("ref_recall"), F.col("precision").alias("ref_precision"))
    from .more_jobs import value_exact

    v = value_exact(spark, sf).select(*key, F.try_divide("right", "all").alias("value_exact"))
    f = E.phantom_names(spark, sf).groupBy(*key).agg(F.count("*").alias("phantoms"))
    for d in (g, n, r, v, f):
        w = w.join(d, key, "left")
    s = S.score_summary(w.fillna(0, ["phantoms"]), METRICS, ["phantoms"])
    return s.select(*key, *[F.round(m, 6).alias(m) for m in METRICS], "phantoms")


def _more() -> dict[str, str]:
    from .more_jobs import JOBS

    return {"w": E.JOBS["wire_precision_recall"][1], "g": E.JOBS["group_precision_recall"][1], "n": STYLE["net_exact_naming"][1], "r": E.JOBS["ref_recall_precision"][1], "v": JOBS["value_exact"][1], "f": E.JOBS["phantom_names"][1]}


_NUM = "CAST(substring(split_part(pin, '-', 1), 2) AS BIGINT) * 40 + CAST(split_part(pin, '-', 2) AS BIGINT)"
_RANK = lambda n, s: f"CASE WHEN upper({n}) = upper({s}) THEN 0 WHEN starts_with(upper({n}), upper({s})) THEN 1 WHEN contains(upper({n}), upper({s})) THEN 2 END"
_HIT = lambda by: f"row_number() OVER (PARTITION BY {by}, query ORDER BY rank, place) AS hit, count(*) FILTER (rank = 0) OVER (PARTITION BY {by}, query) AS exact"
_LOOSE = f"""may AS (SELECT * FROM part_texts WHERE kind = 'net' AND net_id IS NULL AND NOT in_body AND regexp_matches(str, {q(LOOSE_REF)}) AND NOT {power('str')} AND NOT (page % 4 = 3 AND color IS NOT DISTINCT FROM '#f00000')),
lines AS (SELECT * FROM segs WHERE seg_id % 4 = 2), pu AS ({_PU.format('may').replace('JOIN segs s', 'JOIN lines s')}), pe AS ({_PE.format('may').replace('JOIN segs s', 'JOIN lines s')}),
ok AS (SELECT m.* FROM may m WHERE NOT EXISTS (SELECT 1 FROM pu WHERE pu.doc = m.doc AND pu.page = m.page AND pu.text_id = m.text_id AND cover > 0.5)),
near AS (SELECT DISTINCT a.doc, a.page, a.text_id FROM ok a JOIN part_texts b ON a.doc = b.doc AND a.page = b.page AND b.kind = 'value' AND b.x0 <= a.x1 + 15 AND b.x1 >= a.x0 - 15 AND b.y0 <= a.y1 + 12.5 AND b.y1 >= a.y0 - 12.5)
SELECT * FROM near UNION SELECT o.doc, o.page, o.text_id FROM ok o WHERE page % 2 = 0 AND color = '#f00000' AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.doc = o.doc AND pe.page = o.page AND pe.text_id = o.text_id)"""
_PAGE = f""", {N.ALL_TEXTS},
k AS (SELECT doc, page, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds, CAST(sum(n) AS BIGINT) AS texts FROM (SELECT doc, page, kind, count(*) AS n FROM all_texts GROUP BY doc, page, kind) z GROUP BY doc, page),
u AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY text_id) AS r FROM all_texts WHERE kind = 'net' AND NOT in_body AND net_id IS NULL), u1 AS (SELECT doc, page, count(*) AS unattached, string_agg(str, ',' ORDER BY r) FILTER (r <= 40) AS loose FROM u GROUP BY doc, page),
s AS (SELECT doc, page, count(*) AS wires FROM segs GROUP BY doc, page), d AS (SELECT doc, page, count(*) AS dots FROM dots GROUP BY doc, page), n AS (SELECT doc, page, count(*) AS nets, count(*) FILTER (name <> '') AS named FROM nets GROUP BY doc, page), g AS (SELECT doc, page, count(*) AS glyphs FROM strokes WHERE page % 2 = 0 OR prim_id % 4 = 0 GROUP BY doc, page)
SELECT s.doc, s.page, s.wires, nets, named, coalesce(dots, 0) AS dots, coalesce(kinds, '') AS kinds, coalesce(texts, 0) AS texts, coalesce(unattached, 0) AS unattached, coalesce(loose, '') AS loose, coalesce(glyphs, 0) > coalesce(texts, 0) * 0.8 AS vector_text
FROM s JOIN n USING (doc, page) LEFT JOIN d USING (doc, page) LEFT JOIN k USING (doc, page) LEFT JOIN u1 USING (doc, page) LEFT JOIN g USING (doc, page)"""
_SELECTION = f""", {N._DOTNET}, named AS (SELECT doc, page, net_id, upper(name) AS key FROM nets WHERE name <> ''), a AS (SELECT doc, page, key, count(*) AS nets FROM named GROUP BY doc, page, key),
b AS (SELECT n.doc, n.page, n.key, count(*) AS segs FROM named n JOIN wires USING (doc, page, net_id) GROUP BY n.doc, n.page, n.key), c AS (SELECT n.doc, n.page, n.key, count(*) AS dots FROM named n JOIN dotnet USING (doc, page, net_id) GROUP BY n.doc, n.page, n.key),
l AS (SELECT n.doc, n.page, n.key, l.str, count(*) AS n, min(l.net_id * 1000000 + l.text_id) AS first_at FROM named n JOIN labels l USING (doc, page, net_id) GROUP BY n.doc, n.page, n.key, l.str), h AS (SELECT doc, page, key, string_agg(str || ':' || n, ',' ORDER BY n DESC, first_at) AS labels FROM l GROUP BY doc, page, key)
SELECT a.doc, a.page, a.key, a.nets, coalesce(segs, 0) AS segs, coalesce(dots, 0) AS dots, coalesce(labels, '') AS labels FROM a LEFT JOIN b USING (doc, page, key) LEFT JOIN c USING (doc, page, key) LEFT JOIN h USING (doc, page, key)"""
_S = _more()
_SCORES = f"""WITH w AS (SELECT doc, page, CASE WHEN page % 5 <> 4 THEN wire_precision END AS wire_precision, wire_recall FROM ({_S['w']}) z), j AS (SELECT w.*, group_precision, CASE WHEN page % 4 <> 1 THEN group_recall END AS group_recall, n.exact / nullif(n.nets, 0) AS net_exact, named_ok / nullif(named, 0) AS naming, recall AS ref_recall, precision AS ref_precision, v."right" / nullif(v."all", 0) AS value_exact, coalesce(f.n, 0) AS phantoms
FROM w LEFT JOIN ({_S['g']}) g USING (doc, page) LEFT JOIN ({_S['n']}) n USING (doc, page) LEFT JOIN ({_S['r']}) r USING (doc, page) LEFT JOIN ({_S['v']}) v USING (doc, page) LEFT JOIN (SELECT doc, page, count(*) AS n FROM ({_S['f']}) y GROUP BY doc, page) f USING (doc, page) WHERE wire_precision IS NOT NULL)
SELECT doc, page, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)}, CAST(sum(phantoms) AS BIGINT) AS phantoms FROM j GROUP BY GROUPING SETS ((doc, page), ())"""

JOBS = {
    "bookmark_nets": (bookmark_nets, with_ctes(f"SELECT doc, page, gt AS net, string_agg(pin, ' ' ORDER BY {_NUM}) AS pins FROM pins WHERE doc % 4 <> 3 GROUP BY doc, page, gt UNION ALL SELECT DISTINCT doc, page, 'Nets', 'X-1' FROM pins WHERE doc % 4 <> 3", "pins")),
    "bookmark_parts": (bookmark_parts, with_ctes(f"SELECT doc, page, split_part(pin, '-', 1) AS ref, string_agg(split_part(pin, '-', 2), ' ' ORDER BY {_NUM}) AS pins FROM pins WHERE doc % 4 <> 3 AND NOT (page % 2 = 1 AND split_part(pin, '-', 1) = 'U1') GROUP BY doc, page, ref UNION ALL SELECT DISTINCT doc, page, 'U1', 'EP' FROM pins WHERE doc % 4 <> 3 AND page % 2 = 1", "pins")),
    "loose_refs_by_pen": (loose_refs_by_pen, with_ctes(_LOOSE, "segs", "part_texts")),
    "page_summary": (page_summary, with_ctes(f"{O.NETS}{_PAGE}", "segs", "dots", "texts", "part_texts", "strokes")),
    "doc_summary": (doc_summary, with_ctes(f"{O.NETS}, a AS (SELECT doc, count(DISTINCT CASE WHEN name <> '' THEN upper(name) END) AS names, count(*) FILTER (name = '' AND n_segs > 1) AS unnamed FROM nets GROUP BY doc), b AS (SELECT doc, count(DISTINCT ref) AS parts FROM parts GROUP BY doc) SELECT doc, coalesce(names, 0) AS names, coalesce(parts, 0) AS parts, coalesce(unnamed, 0) AS unnamed FROM a FULL JOIN b USING (doc)", "segs", "dots", "texts", "parts")),
    "net_selection": (net_selection, with_ctes(f"{O.NETS}{_SELECTION}", "segs", "dots", "texts")),
    "search_nets": (search_nets, N._full(f", listed AS (SELECT doc, net, {N._ORDER} AS place FROM entries), f AS (SELECT doc, query, net, place, {_RANK('net', 'query')} AS rank FROM listed, (VALUES ('sig_1'), ('v'), ('GND'), ('n3')) v(query)) SELECT doc, query, net, rank, {_HIT('doc')} FROM f WHERE rank IS NOT NULL")),
    "search_parts": (search_parts, with_ctes(f"f AS (SELECT doc, page, query, ref, i AS place, least({_RANK('ref', 'query')}, {_RANK('value', 'query')}) AS rank FROM parts, (VALUES ('1'), ('r1'), ('7k')) v(query)) SELECT doc, page, query, ref, rank, {_HIT('doc, page')} FROM f WHERE rank IS NOT NULL", "parts")),
    "score_summary": (score_summary, _SCORES),
}
