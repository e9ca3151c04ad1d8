"""Queries on wires, nets and their names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_rules import csv_cell, is_bare_voltage, match_rank
from ..operators import graph, nets, spatial, summaries
from ..sources.fixtures import table, tables, with_ctes
from . import oracle as O
from .oracle import dist, natural


def drawn(spark, sf, *more):
    """Named nets, wires, labels, and the tables of the drawing by name, ``more`` of them for a query that reads more. All are made before the netlist keeps any: what is kept of a table is dropped with
    the view by which SQL reads it, so a table made later would have strokes made anew for every reader."""
    names = ["segs", "dots", "texts", *more]
    t = dict(zip(names, tables(spark, sf, *names), strict=True))
    wires, labels = nets.extract(t["segs"], t["dots"], t["texts"])
    return nets.named_nets(wires, labels), wires, labels, t


def _named(spark, sf):
    return drawn(spark, sf)[:3]


def grid_join(spark, sf):
    s = table(spark, sf, "segs").select("doc", "page", "seg_id", "x1", "y1", "x2", "y2")
    meet = lambda l, r: (l["seg_id"] < r["seg_id"]) & (F.greatest(l["x1"], r["x1"]) <= F.least(l["x2"], r["x2"])) & (F.greatest(l["y1"], r["y1"]) <= F.least(l["y2"], r["y2"]))  # noqa: E731, E741
    return spatial.grid_join(s, s, ["doc", "page"], spatial.seg_box(), spatial.seg_box(), 20.0, meet).select("l.doc", "l.page", F.col("l.seg_id").alias("a"), F.col("r.seg_id").alias("b"))


def join_endpoints(spark, sf):
    return spatial.join_endpoints(table(spark, sf, "segs"))


def join_tee(spark, sf):
    return spatial.join_tee(table(spark, sf, "segs"), table(spark, sf, "dots"))


def join_overlap(spark, sf):
    return spatial.join_overlap(table(spark, sf, "segs"))


def join_dot_wires(spark, sf):
    return spatial.join_dot_wires(table(spark, sf, "segs"), table(spark, sf, "dots"))


def connected_components(spark, sf):
    s = table(spark, sf, "segs").select("doc", "page", "seg_id", "x1", "y1", "x2", "y2").persist()
    return graph.connected_components(s, spatial.contacts(s, table(spark, sf, "dots")))


def label_along_wire(spark, sf):
    return spatial.label_along_wire(table(spark, sf, "texts"), table(spark, sf, "segs"))


def merge_same_name(spark, sf):
    t = table(spark, sf, "texts")
    labels = spatial.label_along_wire(t.where(~is_bare_voltage(F.col("str"))), table(spark, sf, "segs")).join(t.select("doc", "page", "text_id", "str"), ["doc", "page", "text_id"])
    return graph.same_name_edges(labels)


def net_build(spark, sf):
    """Nets with their segments, counted and listed, and their box."""
    return nets.net_build(_named(spark, sf)[1]).withColumn("segs", F.array_join(F.transform("segs", lambda s: s.cast("string")), " "))


def net_name_pick(spark, sf):
    return nets.net_name_pick(_named(spark, sf)[2])


def dot_nets(wires, t):
    """Dots with the net of the first wire through them."""
    hits = spatial.dot_hits(t["segs"], t["dots"]).groupBy("doc", "page", "x", "y").agg(F.min("seg_id").alias("seg_id"))
    return hits.join(wires.select("doc", "page", "seg_id", "net_id"), ["doc", "page", "seg_id"]).select("doc", "page", "x", "y", "net_id")


def assign_nets(spark, sf):
    """Dots with the net of the first wire through them."""
    _, wires, _, t = drawn(spark, sf)
    return dot_nets(wires, t)


def net_entries(spark, sf):
    n, _, labels = _named(spark, sf)
    return nets.net_entries(n, labels)


def net_list_sort(spark, sf):
    return nets.net_list_order(net_entries(spark, sf)).select("doc", "net", "place")


def sink_nets_csv(spark, sf):
    """Lines of the nets CSV of each drawing, in the order of its list."""
    e = nets.net_list_order(net_entries(spark, sf))
    return e.select("doc", "place", F.concat_ws(",", csv_cell(F.col("net")), "type", F.col("labels").cast("string"), csv_cell(F.col("pages"))).alias("line"))


def nets_named(spark, sf):
    n, _, _ = _named(spark, sf)
    return n.where(F.upper("name") == "GND").select("doc", "page", "net_id")


def net_info(spark, sf):
    """Per page and name: nets, segments, dots on them and the commonest label with its count."""
    n, wires, labels, t = drawn(spark, sf)
    named = n.where("name <> ''").select("doc", "page", "net_id", "name")
    segs = named.join(wires, ["doc", "page", "net_id"]).groupBy("doc", "page", F.upper("name").alias("key")).agg(F.count("*").alias("segs"), F.count_distinct("net_id").alias("nets"))
    dots = dot_nets(wires, t).join(named, ["doc", "page", "net_id"]).groupBy("doc", "page", F.upper("name").alias("key")).agg(F.count("*").alias("dots"))
    tops = labels.join(named, ["doc", "page", "net_id"]).groupBy("doc", "page", F.upper("name").alias("key"), "str").agg(F.count("*").alias("c"))
    tops = tops.groupBy("doc", "page", "key").agg(F.min(F.struct((-F.col("c")).alias("c"), "str")).alias("t"))
    j = segs.join(dots, ["doc", "page", "key"], "left").join(tops, ["doc", "page", "key"])
    return j.select("doc", "page", "key", "nets", "segs", F.coalesce("dots", F.lit(0)).alias("dots"), F.col("t.str").alias("top_label"), (-F.col("t.c")).alias("top_count"))


def doc_counts(spark, sf):
    """Per drawing: distinct names of its nets, distinct references of its parts, and nets without a name that have two segments or more."""
    n, _, _, t = drawn(spark, sf, "parts")
    return summaries.doc_summary(n, t["parts"])


def labelled(spark, sf):
    """Named nets, wires, the tables they are made of, and all texts of the drawings with the nets that labels name."""
    n, wires, labels, t = drawn(spark, sf, "part_texts", "strokes")
    cols = ["doc", "page", "text_id", "str", "kind", "in_body", "net_id"]
    own = t["texts"].withColumn("in_body", F.col("text_id") % 9 == 4).join(labels.select("doc", "page", "text_id", "net_id"), ["doc", "page", "text_id"], "left")
    return n, wires, t, own.select(cols).unionByName(t["part_texts"].withColumn("text_id", F.col("text_id") + 100000).select(cols))


def page_stats(spark, sf):
    """Every page with wires, dots or texts: wires, nets, named nets, dots, texts and their kinds, labels that name no wire, counted and all listed, and whether its lettering is drawn as strokes."""
    n, wires, t, texts = labelled(spark, sf)
    glyphs = t["strokes"].where("page % 2 = 0 or prim_id % 4 = 0").select("doc", "page", "prim_id")
    pages = t["segs"].select("doc", "page").unionByName(t["dots"].select("doc", "page")).unionByName(texts.select("doc", "page"))
    s = summaries.page_summary(pages, wires, n, t["dots"], texts, glyphs, most=None)
    kinds = F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return s.withColumns({"kinds": kinds, "loose": F.array_join("loose", ",")})


def biggest_nets(spark, sf):
    """The eight nets of a page with most segments and up to ten of their distinct labels."""
    n, _, labels = _named(spark, sf)
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("n_segs"), "net_id"))).where("r <= 8")
    names = labels.groupBy("doc", "page", "net_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("str")), 1, 10), ",").alias("labels"))
    return top.join(names, ["doc", "page", "net_id"], "left").select("doc", "page", "net_id", "r", "n_segs", F.coalesce("labels", F.lit("")).alias("labels"))


def label_occurrences(spark, sf):
    """Labels of one name in reading order over the drawing, each with its position."""
    n, _, labels, made = drawn(spark, sf)
    t = labels.join(n.select("doc", "page", "net_id", "name"), ["doc", "page", "net_id"]).join(made["texts"].select("doc", "page", "text_id", "x0", "y0"), ["doc", "page", "text_id"])
    w = Window.partitionBy("doc", F.upper("name"))
    return t.select("doc", "page", "text_id", F.row_number().over(w.orderBy("doc", "page", "y0", "x0", "text_id")).alias("i"), F.count("*").over(w).alias("n"))


def focus_texts(spark, sf):
    """Per page: labels of the nets named GND together with all texts that read GND."""
    n, _, labels, t = drawn(spark, sf)
    on = labels.join(n.where("upper(name) = 'GND'").select("doc", "page", "net_id"), ["doc", "page", "net_id"]).select("doc", "page", "text_id")
    return on.union(t["texts"].where("upper(str) = 'GND'").select("doc", "page", "text_id")).distinct()


def union_box(spark, sf):
    """Bounding box of all nets of a page that share a name, their labels included."""
    n, _, labels, t = drawn(spark, sf)
    boxes = n.where("name <> ''").select("doc", "page", F.upper("name").alias("key"), "bx0", "by0", "bx1", "by1")
    own = labels.join(n.select("doc", "page", "net_id", "name"), ["doc", "page", "net_id"]).join(t["texts"].select("doc", "page", "text_id", "x0", "y0", "x1", "y1"), ["doc", "page", "text_id"])
    own = own.where("name <> ''").select("doc", "page", F.upper("name").alias("key"), F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    return boxes.unionByName(own).groupBy("doc", "page", "key").agg(F.min("bx0").alias("x0"), F.min("by0").alias("y0"), F.max("bx1").alias("x1"), F.max("by1").alias("y1"))


def search_rank(spark, sf):
    """Several searches at once over the names of all drawings: rank, and place within the answer."""
    e = net_entries(spark, sf).select("doc", "net")
    terms = spark.createDataFrame([("sig_1",), ("v",), ("GND",)], "query string")
    hits = e.crossJoin(F.broadcast(terms)).withColumn("rank", match_rank(F.col("net"), F.col("query"))).where("rank is not null")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("doc", "query").orderBy("rank", "net")))


def _points(d):
    return d.select("doc", "page", (F.col("x") * 1000 + F.col("y")).cast("long").alias("pt"), (F.col("x") + 1.5).alias("x"), (F.col("y") + 0.75).alias("y"))


_POINTS = "points AS (SELECT doc, page, CAST(x * 1000 + y AS BIGINT) AS pt, x + 1.5 AS x, y + 0.75 AS y FROM dots)"


def seg_at(spark, sf):
    return spatial.seg_at(_points(table(spark, sf, "dots")), table(spark, sf, "segs"), 9.0)


def text_at(spark, sf):
    return spatial.text_at(_points(table(spark, sf, "dots")), table(spark, sf, "texts"), 2.0)


def nets_near(spark, sf):
    _, wires, _, t = drawn(spark, sf)
    return spatial.nets_near(_points(t["dots"]), wires, 9.0)


def touch_decision(spark, sf):
    """What a touch selects: nothing, one net, or up to four to choose from. A net is sure within 1; others within 3 of the nearest compete; nets
    that select the same name count once."""
    n, wires, _, t = drawn(spark, sf)
    near = spatial.nets_near(_points(t["dots"]), wires, 9.0).join(n.select("doc", "page", "net_id", "name"), ["doc", "page", "net_id"])
    w = Window.partitionBy("doc", "page", "pt")
    near = near.withColumn("least", F.min("d").over(w))
    near = near.where(((F.col("least") <= 1) & (F.col("d") <= 1)) | ((F.col("least") > 1) & (F.col("d") - F.col("least") < 3)))
    key = F.when(F.col("name") == "", F.concat(F.lit("#"), F.col("net_id").cast("string"))).otherwise(F.upper("name"))
    once = near.groupBy("doc", "page", "pt", key.alias("key")).agg(F.min(F.struct("d", "net_id")).alias("b"))
    ranked = once.withColumn("r", F.row_number().over(w.orderBy("b.d", "b.net_id"))).where("r <= 4")
    return ranked.groupBy("doc", "page", "pt").agg(F.when(F.count("*") == 1, "pick").otherwise("choose").alias("kind"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "b.net_id"))), lambda x: x["net_id"].cast("string")), ",").alias("nets"))


def longest_wires(spark, sf):
    s = table(spark, sf, "segs").withColumn("len", F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")))
    return s.withColumn("r", F.row_number().over(Window.partitionBy("doc", "page").orderBy(F.desc("len"), "seg_id"))).where("r <= 12").select("doc", "page", "seg_id", "len", "r")


FX = ("segs", "dots", "texts")
_full = lambda body: with_ctes(f"{O.NETS}, {O.ENTRIES} {body}", *FX)
_nets = lambda body: with_ctes(f"{O.NETS}{body if body[0] == ',' else ' ' + body}", *FX)
_ORDER = f"row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN type = 'power' THEN 0 ELSE 1 END, {natural('net')}, net)"
_DOTNET = "dotnet AS (SELECT h.doc, h.page, h.x, h.y, w.net_id FROM (SELECT doc, page, x, y, min(seg_id) AS seg_id FROM hits GROUP BY doc, page, x, y) h JOIN wires w ON h.doc = w.doc AND h.page = w.page AND h.seg_id = w.seg_id)"
_CSV = lambda s: f"CASE WHEN regexp_matches({s}, '^[=+\\-@]') THEN '\"=\"\"' || {s} || '\"\"\"' ELSE {s} END"
_NEAR = f"near AS (SELECT p.doc, p.page, p.pt, w.net_id, round(min({dist('p.x', 'p.y', 'w.x1', 'w.y1', 'w.x2', 'w.y2')}), 6) AS d FROM points p JOIN wires w ON p.doc = w.doc AND p.page = w.page AND {dist('p.x', 'p.y', 'w.x1', 'w.y1', 'w.x2', 'w.y2')} <= 9 GROUP BY p.doc, p.page, p.pt, w.net_id)"
ALL_TEXTS = "all_texts AS (SELECT t.doc, t.page, t.text_id, t.str, t.kind, t.text_id % 9 = 4 AS in_body, l.net_id FROM texts t LEFT JOIN labels l ON t.doc = l.doc AND t.page = l.page AND t.text_id = l.text_id UNION ALL SELECT doc, page, text_id + 100000, str, kind, in_body, net_id FROM part_texts)"

JOBS = {
    "grid_join": (grid_join, with_ctes("SELECT a.doc, a.page, a.seg_id AS a, b.seg_id AS b FROM segs a JOIN segs b ON a.doc = b.doc AND a.page = b.page AND a.seg_id < b.seg_id AND greatest(a.x1, b.x1) <= least(a.x2, b.x2) AND greatest(a.y1, b.y1) <= least(a.y2, b.y2)", "segs")),
    "join_endpoints": (join_endpoints, with_ctes(f"{O.ENDS}, {O.SHARED} SELECT * FROM e1", "segs")),
    "join_tee": (join_tee, with_ctes(f"{O.ENDS}, {O.ON}, {O.TEE} SELECT * FROM e2", "segs", "dots")),
    "join_overlap": (join_overlap, with_ctes(f"{O.OVERLAP} SELECT * FROM e3", "segs")),
    "join_dot_wires": (join_dot_wires, with_ctes(f"{O.HITS}, {O.THROUGH} SELECT * FROM e4", "segs", "dots")),
    "connected_components": (connected_components, with_ctes(f"{O.CONTACTS}, {O.components('touch')} SELECT doc, page, seg_id, root FROM cc", "segs", "dots")),
    "label_along_wire": (label_along_wire, with_ctes(f"{O.LABELS} SELECT doc, page, text_id, seg_id FROM labels0", "texts")),
    "merge_same_name": (merge_same_name, with_ctes(f"{O.LABELS}, {O.NAMES} SELECT * FROM e5", "texts")),
    "net_build": (net_build, _nets("SELECT b.*, s.segs FROM built b JOIN (SELECT doc, page, net_id, string_agg(seg_id, ' ' ORDER BY seg_id) AS segs FROM wires GROUP BY doc, page, net_id) s ON b.doc = s.doc AND b.page = s.page AND b.net_id = s.net_id")),
    "net_name_pick": (net_name_pick, _nets("SELECT * FROM picked")),
    "assign_nets": (assign_nets, _nets(f", {_DOTNET} SELECT * FROM dotnet")),
    "net_entries": (net_entries, _full("SELECT doc, net, type, labels, pages, n_nets, n_segs FROM entries")),
    "net_list_sort": (net_list_sort, _full(f"SELECT doc, net, {_ORDER} AS place FROM entries")),
    "sink_nets_csv": (sink_nets_csv, _full(f"SELECT doc, {_ORDER} AS place, {_CSV('net')} || ',' || type || ',' || labels || ',' || pages AS line FROM entries")),
    "nets_named": (nets_named, _nets("SELECT doc, page, net_id FROM nets WHERE upper(name) = 'GND'")),
    "net_info": (net_info, _nets(f""", {_DOTNET}, named AS (SELECT doc, page, net_id, upper(name) AS key FROM nets WHERE name <> ''),
a AS (SELECT n.doc, n.page, n.key, count(*) AS segs, count(DISTINCT n.net_id) AS nets FROM named n JOIN wires w ON n.doc = w.doc AND n.page = w.page AND n.net_id = w.net_id GROUP BY n.doc, n.page, n.key),
b AS (SELECT n.doc, n.page, n.key, count(*) AS dots FROM named n JOIN dotnet d ON n.doc = d.doc AND n.page = d.page AND n.net_id = d.net_id GROUP BY n.doc, n.page, n.key),
c AS (SELECT n.doc, n.page, n.key, l.str, count(*) AS c FROM named n JOIN labels l ON n.doc = l.doc AND n.page = l.page AND n.net_id = l.net_id GROUP BY n.doc, n.page, n.key, l.str),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, key ORDER BY c DESC, str) AS r FROM c) z WHERE r = 1)
SELECT a.doc, a.page, a.key, a.nets, a.segs, coalesce(b.dots, 0) AS dots, t.str AS top_label, t.c AS top_count FROM a JOIN t ON a.doc = t.doc AND a.page = t.page AND a.key = t.key LEFT JOIN b ON a.doc = b.doc AND a.page = b.page AND a.key = b.key""")),
    "doc_counts": (doc_counts, with_ctes(f"""{O.NETS}, n AS (SELECT doc, count(DISTINCT CASE WHEN name <> '' THEN upper(name) END) AS names, count(*) FILTER (name = '' AND n_segs > 1) AS unnamed FROM nets GROUP BY doc), p AS (SELECT doc, count(DISTINCT ref) AS parts FROM parts GROUP BY doc)
SELECT doc, coalesce(names, 0) AS names, coalesce(parts, 0) AS parts, coalesce(unnamed, 0) AS unnamed FROM n FULL JOIN p USING (doc)""", *FX, "parts")),
    "page_stats": (page_stats, with_ctes(f"""{O.NETS}, {ALL_TEXTS},
pages AS (SELECT doc, page FROM segs UNION SELECT doc, page FROM dots UNION SELECT doc, page FROM all_texts), w AS (SELECT doc, page, count(*) AS wires FROM segs GROUP BY doc, page), n AS (SELECT doc, page, count(*) AS nets, count(*) FILTER (name <> '') AS named FROM nets GROUP BY doc, page),
d AS (SELECT doc, page, count(*) AS dots FROM dots GROUP BY doc, page), k AS (SELECT doc, page, string_agg(kind || ':' || n, ',' ORDER BY kind) AS kinds, CAST(sum(n) AS BIGINT) AS texts FROM (SELECT doc, page, kind, count(*) AS n FROM all_texts GROUP BY doc, page, kind) z GROUP BY doc, page),
u AS (SELECT doc, page, count(*) AS unattached, string_agg(str, ',' ORDER BY text_id) AS loose FROM all_texts WHERE kind = 'net' AND NOT in_body AND net_id IS NULL GROUP BY doc, page), g AS (SELECT doc, page, count(*) AS glyphs FROM strokes WHERE page % 2 = 0 OR prim_id % 4 = 0 GROUP BY doc, page)
SELECT p.doc, p.page, coalesce(wires, 0) AS wires, coalesce(nets, 0) AS nets, coalesce(named, 0) AS named, coalesce(dots, 0) AS dots, coalesce(kinds, '') AS kinds, coalesce(texts, 0) AS texts, coalesce(unattached, 0) AS unattached, coalesce(loose, '') AS loose, coalesce(glyphs, 0) > coalesce(texts, 0) * 0.8 AS vector_text
FROM pages p LEFT JOIN w USING (doc, page) LEFT JOIN n USING (doc, page) LEFT JOIN d USING (doc, page) LEFT JOIN k USING (doc, page) LEFT JOIN u USING (doc, page) LEFT JOIN g USING (doc, page)""", *FX, "part_texts", "strokes")),
    "biggest_nets": (biggest_nets, _nets("""SELECT n.doc, n.page, n.net_id, n.r, n.n_segs, coalesce(l.labels, '') AS labels FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY n_segs DESC, net_id) AS r FROM nets) n
LEFT JOIN (SELECT doc, page, net_id, array_to_string(list_sort(list(DISTINCT str))[1:10], ',') AS labels FROM labels GROUP BY doc, page, net_id) l ON n.doc = l.doc AND n.page = l.page AND n.net_id = l.net_id WHERE n.r <= 8""")),
    "label_occurrences": (label_occurrences, _nets("""SELECT l.doc, l.page, l.text_id, row_number() OVER (PARTITION BY n.doc, upper(n.name) ORDER BY l.doc, l.page, t.y0, t.x0, l.text_id) AS i, count(*) OVER (PARTITION BY n.doc, upper(n.name)) AS n
FROM labels l JOIN nets n ON l.doc = n.doc AND l.page = n.page AND l.net_id = n.net_id JOIN texts t ON l.doc = t.doc AND l.page = t.page AND l.text_id = t.text_id""")),
    "focus_texts": (focus_texts, _nets("SELECT l.doc, l.page, l.text_id FROM labels l JOIN nets n ON l.doc = n.doc AND l.page = n.page AND l.net_id = n.net_id WHERE upper(n.name) = 'GND' UNION SELECT doc, page, text_id FROM texts WHERE upper(str) = 'GND'")),
    "union_box": (union_box, _nets("""SELECT doc, page, key, min(a) AS x0, min(b) AS y0, max(c) AS x1, max(d) AS y1 FROM (SELECT doc, page, upper(name) AS key, bx0 AS a, by0 AS b, bx1 AS c, by1 AS d FROM nets WHERE name <> ''
UNION ALL SELECT l.doc, l.page, upper(n.name), t.x0, t.y0, t.x1, t.y1 FROM labels l JOIN nets n ON l.doc = n.doc AND l.page = n.page AND l.net_id = n.net_id JOIN texts t ON l.doc = t.doc AND l.page = t.page AND l.text_id = t.text_id WHERE n.name <> '') z GROUP BY doc, page, key""")),
    "search_rank": (search_rank, _full("""SELECT doc, net, query, rank, row_number() OVER (PARTITION BY doc, query ORDER BY rank, net) AS place FROM (SELECT doc, net, query, CASE WHEN upper(net) = upper(query) THEN 0 WHEN starts_with(upper(net), upper(query)) THEN 1 WHEN contains(upper(net), upper(query)) THEN 2 END AS rank
FROM entries, (VALUES ('sig_1'), ('v'), ('GND')) v(query)) z WHERE rank IS NOT NULL""")),
    "seg_at": (seg_at, with_ctes(f"{_POINTS}, c AS (SELECT p.doc, p.page, p.pt, s.seg_id, {dist('p.x', 'p.y', 's.x1', 's.y1', 's.x2', 's.y2')} AS d FROM points p JOIN segs s ON p.doc = s.doc AND p.page = s.page) SELECT doc, page, pt, seg_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, pt ORDER BY d, seg_id DESC) AS r FROM c WHERE d <= 9) z WHERE r = 1", "segs", "dots")),
    "text_at": (text_at, with_ctes(f"{_POINTS}, c AS (SELECT p.doc, p.page, p.pt, t.text_id, (t.x1 - t.x0) * (t.y1 - t.y0) AS a FROM points p JOIN texts t ON p.doc = t.doc AND p.page = t.page AND p.x BETWEEN t.x0 - 2 AND t.x1 + 2 AND p.y BETWEEN t.y0 - 2 AND t.y1 + 2) SELECT doc, page, pt, text_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, pt ORDER BY a, text_id) AS r FROM c) z WHERE r = 1", "texts", "dots")),
    "nets_near": (nets_near, _nets(f", {_POINTS}, {_NEAR} SELECT doc, page, pt, net_id, d FROM near")),
    "touch_decision": (touch_decision, _nets(f""", {_POINTS}, {_NEAR}, l AS (SELECT a.*, n.name, min(a.d) OVER (PARTITION BY a.doc, a.page, a.pt) AS least_d FROM near a JOIN nets n ON a.doc = n.doc AND a.page = n.page AND a.net_id = n.net_id),
k AS (SELECT doc, page, pt, d, net_id, CASE WHEN name = '' THEN '#' || net_id ELSE upper(name) END AS key FROM l WHERE (least_d <= 1 AND d <= 1) OR (least_d > 1 AND d - least_d < 3)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, pt, key ORDER BY d, net_id) AS i FROM k) z WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page, pt ORDER BY d, net_id) AS r FROM o)
SELECT doc, page, pt, CASE WHEN count(*) = 1 THEN 'pick' ELSE 'choose' END AS kind, count(*) AS n, string_agg(CAST(net_id AS STRING), ',' ORDER BY r) AS nets FROM r WHERE r <= 4 GROUP BY doc, page, pt""")),
    "longest_wires": (longest_wires, with_ctes("SELECT doc, page, seg_id, len, r FROM (SELECT doc, page, seg_id, x2 - x1 + y2 - y1 AS len, row_number() OVER (PARTITION BY doc, page ORDER BY x2 - x1 + y2 - y1 DESC, seg_id) AS r FROM segs) z WHERE r <= 12", "segs")),
}
