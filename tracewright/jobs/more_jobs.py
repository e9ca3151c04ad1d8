"""Further queries: bookmarks, pins, bodies, boxes, look-ups, readers by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text_rules import strip_count
from ..operators import bodies as B
from ..operators import labels
from ..operators.spatial import grid_join, point_box, seg_box, text_box
from ..sources.fixtures import table, with_ctes
from .oracle import gap


def nearest_segment(spark, sf):
    """The segment nearest to each text box within 6, the first of equally near ones."""
    return labels.nearest_segment(table(spark, sf, "texts"), table(spark, sf, "segs"), "text_id", 6.0).withColumn("d", F.round("d", 6))


def _bodies(spark, sf):
    """Part outlines around the places of parts, of three sizes."""
    p = table(spark, sf, "parts")
    half = F.element_at(F.array(F.lit(12.0), F.lit(25.0), F.lit(45.0)), (F.col("i") % 3 + 1).cast("int"))
    return p.select("doc", "page", F.col("i").cast("long").alias("body"), "ref", (F.col("x") - half).alias("x0"), (F.col("y") - half).alias("y0"), (F.col("x") + half).alias("x1"), (F.col("y") + half).alias("y1"))


BODIES = "bodies AS (SELECT doc, page, i AS body, ref, x - h AS x0, y - h AS y0, x + h AS x1, y + h AS y1 FROM (SELECT *, CASE i % 3 WHEN 0 THEN 12.0 WHEN 1 THEN 25.0 ELSE 45.0 END AS h FROM parts) z)"


def _pages(spark, sf):
    """Text height and area of each page; larger ones take larger outlines."""
    return table(spark, sf, "heights").withColumn("area", 20000.0 + F.col("page") * 5000)


def text_in_body(spark, sf):
    return B.text_in_body(table(spark, sf, "texts"), _bodies(spark, sf), table(spark, sf, "segs"), _pages(spark, sf))


def flag_of_label(spark, sf):
    """Boxes around some of the labels, and some further ones."""
    f = table(spark, sf, "flags").withColumnRenamed("text_id", "body")
    wide = f.where("body % 8 = 1").select("doc", "page", (F.col("body") + 10000).alias("body"), (F.col("x0") - 1).alias("x0"), "y0", "x1", "y1")
    return B.flag_of_label(table(spark, sf, "texts"), f.unionByName(wide), _pages(spark, sf))


def part_at(spark, sf):
    """The smallest part outline at each dot."""
    d = table(spark, sf, "dots")
    inside = lambda l, r: (l["x"] >= r["x0"]) & (l["x"] <= r["x1"]) & (l["y"] >= r["y0"]) & (l["y"] <= r["y1"])  # noqa: E731, E741
    j = grid_join(d, _bodies(spark, sf), ["doc", "page"], point_box(), text_box(), 40.0, inside)
    area = (F.col("r.x1") - F.col("r.x0")) * (F.col("r.y1") - F.col("r.y0"))
    return j.select("l.doc", "l.page", "l.x", "l.y", area.alias("a"), "r.body").groupBy("doc", "page", "x", "y").agg(F.min(F.struct("a", "body")).alias("b")).select("doc", "page", "x", "y", "b.body")


def wire_end_at_box(spark, sf):
    """Wires with one end inside a small outline and the other outside: the one whose end lies nearest to its centre."""
    return labels.wire_end_at_box(_bodies(spark, sf).where("x1 - x0 <= 24"), table(spark, sf, "segs"), "body")


def _outline(spark, sf):
    """A bookmark tree: doc, page, Nets (n), net, Pins (n), pin; a node is its path."""
    p = table(spark, sf, "pins")
    top = p.select("doc", "page").distinct().select("doc", "page", F.lit("n").alias("node"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("Nets ("), F.col("page").cast("string"), F.lit(")")).alias("title"))
    net = p.select("doc", "page", "gt").distinct().select("doc", "page", F.concat(F.lit("n/"), "gt").alias("node"), F.lit("n").alias("parent"), F.col("gt").alias("title"))
    pins = p.select("doc", "page", "gt").distinct().select("doc", "page", F.concat(F.lit("n/"), "gt", F.lit("/p")).alias("node"), F.concat(F.lit("n/"), "gt").alias("parent"), F.lit("Pins (9)").alias("title"))
    pin = p.select("doc", "page", F.concat(F.lit("n/"), "gt", F.lit("/p/"), "pin").alias("node"), F.concat(F.lit("n/"), "gt", F.lit("/p")).alias("parent"), F.col("pin").alias("title"))
    return top.unionByName(net).unionByName(pins).unionByName(pin)


def outline_netlist(spark, sf):
    """Net and pin of each leaf of the bookmark tree: Nets, net, Pins, pin."""
    o = _outline(spark, sf)
    level = lambda n: o.select("doc", "page", F.col("node").alias(f"n{n}"), F.col("parent").alias(f"p{n}"), F.col("title").alias(f"t{n}"))
    j = level(0).where(strip_count(F.col("t0")) == "Nets").select("doc", "page", "n0")
    j = j.join(level(1).withColumnRenamed("p1", "n0"), ["doc", "page", "n0"])
    j = j.join(level(2).withColumnRenamed("p2", "n1"), ["doc", "page", "n1"]).where(strip_count(F.col("t2")) == "Pins")
    j = j.join(level(3).withColumnRenamed("p3", "n2"), ["doc", "page", "n2"])
    return j.select("doc", "page", F.col("t1").alias("net"), F.col("t3").alias("pin"))


def decode_pin(spark, sf):
    """Codes "part + 0 + pin" split by the parts and pins of the sheet, the longest known part first; else by the first zero after a number."""
    p = table(spark, sf, "pins").select("doc", "page", F.split_part("pin", F.lit("-"), F.lit(1)).alias("ref"), F.split_part("pin", F.lit("-"), F.lit(2)).alias("no"))
    codes = p.select("doc", "page", F.concat("ref", F.lit("0"), "no").alias("code")).distinct()
    cut = codes.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("code") - 2, F.lit(1)))))
    cut = cut.select("doc", "page", "code", "at", F.substring("code", F.lit(1), F.col("at")).alias("ref"), F.substring("code", F.col("at") + 1, F.lit(1)).alias("zero"), F.substring("code", F.col("at") + 2, F.length("code")).alias("no")).where("zero = '0'")
    known = cut.join(p.where("ref <> 'U7'"), ["doc", "page", "ref", "no"], "left_semi").groupBy("doc", "page", "code").agg(F.max_by(F.concat_ws("-", "ref", "no"), "at").alias("pin"))
    rule = F.regexp_extract("code", r"(?i)^([A-Z]+\d+?)0(\w+)$", 1)
    plain = F.when(rule != "", F.concat_ws("-", rule, F.regexp_extract("code", r"(?i)^([A-Z]+\d+?)0(\w+)$", 2)))
    return codes.join(known, ["doc", "page", "code"], "left").select("doc", "page", "code", F.coalesce("pin", plain).alias("pin"))


def data_kind(spark, sf):
    """What a drawing holds: nothing, no text, or both."""
    d = table(spark, sf, "segs").groupBy("doc").agg(F.count("*").alias("n")).join(table(spark, sf, "texts").where("doc % 3 <> 1").groupBy("doc").agg(F.count("*").alias("t")), "doc", "left")
    return d.select("doc", F.when(F.col("n") == 0, "empty").when(F.coalesce("t", F.lit(0)) == 0, "no_text").otherwise("ok").alias("kind"))


def explode_segments(spark, sf):
    """Straight orthogonal pieces of sub-paths; the paths chain each wire with a slanted piece and a step."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    p = table(spark, sf, "segs").select("doc", "page", "seg_id", F.array(pt(c("x1"), c("y1")), pt(c("x2"), c("y2")), pt(c("x2") + 3, c("y2") + 4), pt(c("x2") + 3, c("y2") + 9)).alias("pts"), F.array(F.lit(True), F.lit(True), c("seg_id") % 2 == 0).alias("straight"))
    p = p.select("doc", "page", "seg_id", F.posexplode(F.arrays_zip(F.slice("pts", 1, 3).alias("a"), F.slice("pts", 2, 3).alias("b"), c("straight").alias("s"))).alias("i", "z"))
    flat = (F.abs(c("z.a.x") - c("z.b.x")) < 0.02) | (F.abs(c("z.a.y") - c("z.b.y")) < 0.02)
    return p.where(c("z.s") & flat).select("doc", "page", "seg_id", "i", c("z.a.x").alias("x1"), c("z.a.y").alias("y1"), c("z.b.x").alias("x2"), c("z.b.y").alias("y2"))


def text_box_of(spark, sf):
    """Box, anchor and turn of texts from their matrix, y downwards on a page 842 high."""
    t = table(spark, sf, "texts").withColumn("w", 3.0 * F.length("str"))
    level = F.col("rot") == 0
    m = [F.when(level, F.lit(5.0)).otherwise(0.0), F.when(level, F.lit(0.0)).otherwise(5.0), F.when(level, F.lit(0.0)).otherwise(-5.0), F.when(level, F.lit(5.0)).otherwise(0.0), F.col("ax"), 842 - F.col("ay")]
    size = F.sqrt(m[2] * m[2] + m[3] * m[3])
    ux, uy = m[0] / size, m[1] / size
    ex, ey = m[4] + ux * F.col("w"), m[5] + uy * F.col("w")
    vx, vy = m[2], m[3]
    xs, ys = [m[4], ex, m[4] + vx, ex + vx], [m[5], ey, m[5] + vy, ey + vy]
    turn = F.floor(-F.degrees(F.atan2(m[1], m[0])) + 0.5).cast("int")
    return t.select("doc", "page", "text_id", F.least(*xs).alias("x0"), (842 - F.greatest(*ys)).alias("y0"), F.greatest(*xs).alias("x1"), (842 - F.least(*ys)).alias("y1"), size.alias("size"), turn.alias("rot"))


def value_exact(spark, sf):
    """Per page: parts whose value is printed on the page and whose first value is it."""
    p = table(spark, sf, "parts")
    ours = p.select("doc", "page", "ref", F.when(F.col("i") % 6 == 1, F.lit("1k")).otherwise(F.col("value")).alias("got"))
    want = p.where("value is not null").select("doc", "page", "ref", F.col("value").alias("want"))
    printed = p.where("i % 4 <> 0 and value is not null").select("doc", "page", F.col("value").alias("want")).distinct()
    j = ours.join(want, ["doc", "page", "ref"]).join(printed, ["doc", "page", "want"], "left_semi")
    return j.groupBy("doc", "page").agg(F.count("*").alias("all"), F.sum(F.coalesce(F.col("got") == F.col("want"), F.lit(False)).cast("long")).alias("right"))


def search_union(spark, sf):
    """Texts of a page together with the references of its parts as texts without lettering."""
    return table(spark, sf, "texts").select("doc", "page", F.col("text_id").cast("long").alias("id"), "str", F.lit(True).alias("lettered")).unionByName(table(spark, sf, "parts").select("doc", "page", (-F.col("i")).cast("long").alias("id"), F.col("ref").alias("str"), F.lit(False).alias("lettered")))


def pin_to_net(spark, sf):
    """Net of each pin by the bookmark netlist of the page; pins that it does not list are left out."""
    p = table(spark, sf, "pins")
    return p.select("doc", "page", "pin", "pred").join(outline_netlist(spark, sf).where("net <> 'N3'"), ["doc", "page", "pin"])


JOBS = {
    "nearest_segment": (nearest_segment, with_ctes(f"c AS (SELECT t.doc, t.page, t.text_id, s.seg_id, round({gap(('t.x0', 't.y0', 't.x1', 't.y1'), ('s.x1', 's.y1', 's.x2', 's.y2'))}, 6) AS d FROM texts t JOIN segs s ON t.doc = s.doc AND t.page = s.page) SELECT doc, page, text_id, seg_id, d FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, text_id ORDER BY d, seg_id) AS r FROM c WHERE d <= 6) z WHERE r = 1", "texts")),
    "text_in_body": (text_in_body, with_ctes(f"""{BODIES}, big AS (SELECT *, (x1 - x0) * (y1 - y0) AS size FROM bodies WHERE (x1 - x0) * (y1 - y0) > 150 AND least(x1 - x0, y1 - y0) > 7.5),
w AS (SELECT b.doc, b.page, b.body FROM segs s JOIN big b ON s.doc = b.doc AND s.page = b.page AND s.x1 > b.x0 + 0.5 AND s.x2 < b.x1 - 0.5 AND s.y1 > b.y0 + 0.5 AND s.y2 < b.y1 - 0.5 GROUP BY b.doc, b.page, b.body HAVING count(*) >= 2),
ok AS (SELECT b.* FROM big b ANTI JOIN w USING (doc, page, body) WHERE size <= 5000 + b.page * 1250)
SELECT doc, page, text_id, body FROM (SELECT t.doc, t.page, t.text_id, b.body, row_number() OVER (PARTITION BY t.doc, t.page, t.text_id ORDER BY b.size, b.body) AS r FROM texts t JOIN ok b ON t.doc = b.doc AND t.page = b.page AND (t.x0 + t.x1) / 2 > b.x0 AND (t.x0 + t.x1) / 2 < b.x1 AND (t.y0 + t.y1) / 2 > b.y0 AND (t.y0 + t.y1) / 2 < b.y1
  WHERE EXISTS (SELECT 1 FROM dots d WHERE d.doc = t.doc AND d.page = t.page)) z WHERE r = 1""", "segs", "dots", "texts", "parts")),
    "flag_of_label": (flag_of_label, with_ctes("""f AS (SELECT doc, page, text_id AS body, x0, y0, x1, y1 FROM flags UNION ALL SELECT doc, page, text_id + 10000, x0 - 1, y0, x1, y1 FROM flags WHERE text_id % 8 = 1), small AS (SELECT f.* FROM f SEMI JOIN dots d ON f.doc = d.doc AND f.page = d.page WHERE NOT ((x1 - x0) * (y1 - y0) > 150 AND least(x1 - x0, y1 - y0) > 7.5)),
one AS (SELECT b.doc, b.page, b.body, min(t.text_id) AS text_id FROM small b JOIN texts t ON t.doc = b.doc AND t.page = b.page AND t.x0 >= b.x0 - 0.75 AND t.x1 <= b.x1 + 0.75 AND t.y0 >= b.y0 - 0.75 AND t.y1 <= b.y1 + 0.75 GROUP BY b.doc, b.page, b.body HAVING count(*) = 1)
SELECT doc, page, text_id, max(body) AS body FROM one GROUP BY doc, page, text_id""", "dots", "flags")),
    "part_at": (part_at, with_ctes(f"{BODIES}, c AS (SELECT d.doc, d.page, d.x, d.y, b.body, (b.x1-b.x0)*(b.y1-b.y0) AS a FROM dots d JOIN bodies b ON d.doc = b.doc AND d.page = b.page AND d.x BETWEEN b.x0 AND b.x1 AND d.y BETWEEN b.y0 AND b.y1) SELECT doc, page, x, y, body FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, x, y ORDER BY a, body) AS r FROM c) z WHERE r = 1", "dots", "parts")),
    "wire_end_at_box": (wire_end_at_box, with_ctes(f"""{BODIES}, c AS (SELECT b.doc, b.page, b.body, s.seg_id, s.x1, s.y1, s.x2, s.y2, (b.x0+b.x1)/2 AS cx, (b.y0+b.y1)/2 AS cy, s.x1 BETWEEN b.x0 AND b.x1 AND s.y1 BETWEEN b.y0 AND b.y1 AS i1, s.x2 BETWEEN b.x0 AND b.x1 AND s.y2 BETWEEN b.y0 AND b.y1 AS i2 FROM bodies b JOIN segs s ON s.doc = b.doc AND s.page = b.page WHERE b.x1 - b.x0 <= 24),
e AS (SELECT doc, page, body, seg_id, round(sqrt(power(CASE WHEN i1 THEN x1 ELSE x2 END - cx, 2) + power(CASE WHEN i1 THEN y1 ELSE y2 END - cy, 2)), 6) AS d FROM c WHERE i1 <> i2) SELECT doc, page, body, seg_id, d FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, body ORDER BY d, seg_id) AS r FROM e) z WHERE r = 1""", "segs", "parts")),
    "outline_netlist": (outline_netlist, with_ctes("SELECT doc, page, gt AS net, pin FROM pins", "pins")),
    "decode_pin": (decode_pin, with_ctes("""p AS (SELECT doc, page, split_part(pin, '-', 1) AS ref, split_part(pin, '-', 2) AS no FROM pins), c AS (SELECT DISTINCT doc, page, ref || '0' || no AS code FROM p),
k AS (SELECT c.doc, c.page, c.code, arg_max(p.ref || '-' || p.no, length(p.ref)) AS pin FROM c JOIN p ON c.doc = p.doc AND c.page = p.page AND c.code = p.ref || '0' || p.no WHERE p.ref <> 'U7' GROUP BY c.doc, c.page, c.code)
SELECT c.doc, c.page, c.code, coalesce(k.pin, CASE WHEN regexp_matches(c.code, '(?i)^([A-Z]+\\d+?)0(\\w+)$') THEN regexp_replace(c.code, '(?i)^([A-Z]+\\d+?)0(\\w+)$', '\\1-\\2') END) AS pin FROM c LEFT JOIN k ON c.doc = k.doc AND c.page = k.page AND c.code = k.code""", "pins")),
    "data_kind": (data_kind, with_ctes("SELECT s.doc, CASE WHEN s.n = 0 THEN 'empty' WHEN coalesce(t.t, 0) = 0 THEN 'no_text' ELSE 'ok' END AS kind FROM (SELECT doc, count(*) AS n FROM segs GROUP BY doc) s LEFT JOIN (SELECT doc, count(*) AS t FROM texts WHERE doc % 3 <> 1 GROUP BY doc) t ON s.doc = t.doc", "texts")),
    "explode_segments": (explode_segments, with_ctes("SELECT doc, page, seg_id, 0 AS i, x1, y1, x2, y2 FROM segs UNION ALL SELECT doc, page, seg_id, 2, x2 + 3, y2 + 4, x2 + 3, y2 + 9 FROM segs WHERE seg_id % 2 = 0", "segs")),
    "text_box": (text_box_of, with_ctes("SELECT doc, page, text_id, x0, y0, x1, y1, size, rot FROM texts", "texts")),
    "value_exact": (value_exact, with_ctes("""j AS (SELECT p.doc, p.page, p.value, CASE WHEN p.i % 6 = 1 THEN '1k' ELSE p.value END AS got FROM parts p WHERE p.value IS NOT NULL AND EXISTS (SELECT 1 FROM parts o WHERE o.doc = p.doc AND o.page = p.page AND o.i % 4 <> 0 AND o.value = p.value)) SELECT doc, page, count(*) AS "all", count(*) FILTER (got = value) AS "right" FROM j GROUP BY doc, page""", "parts")),
    "search_union": (search_union, with_ctes("SELECT doc, page, text_id AS id, str, true AS lettered FROM texts UNION ALL SELECT doc, page, -i, ref, false FROM parts", "texts", "parts")),
    "pin_to_net": (pin_to_net, with_ctes("SELECT doc, page, pin, pred, gt AS net FROM pins WHERE gt <> 'N3'", "pins")),
}
