"""Queries on the texts and strokes of single pages: statistics, runs, duplicates, readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text_rules import MARKER
from ..operators import pens, repeats
from ..operators.spatial import grid_join
from ..sources.fixtures import table, with_ctes
from ..sources.shared import by_page
from .oracle import q


def letters(spark, sf):
    """Words of documents as texts on lines of a page: eight to a line, some gaps wide. Documents are dealt by page before they are cut into words, so that words need no shuffle."""
    page = [F.floor(F.col("doc_id") / 5).alias("doc"), (F.col("doc_id") % 5).alias("page")]
    d = by_page(table(spark, sf, "documents").select("doc_id", "text", *page)).select("doc_id", "doc", "page", F.posexplode(F.split("text", "[ \n]+")).alias("i", "str")).where("str <> ''")
    kind = F.when(F.length("str") % 5 == 0, "pin").when(F.length("str") % 3 == 0, "value").otherwise("net")
    x = ((F.col("i") % 8) * 40).cast("double")
    size = F.when(F.col("doc_id") % 5 % 3 == 0, 6.0).otherwise(5.0)
    return d.select("doc", "page", F.col("i").alias("text_id"), "str", kind.alias("kind"), x.alias("x0"), (x + F.when(F.length("str") % 4 == 0, 38.0).otherwise(30.0)).alias("x1"), (F.floor(F.col("i") / 8) * 10).cast("double").alias("y"), (size + (F.col("i") % 4)).alias("size"))


LETTERS = """letters AS (SELECT doc, page, text_id, str, CASE WHEN length(str) % 5 = 0 THEN 'pin' WHEN length(str) % 3 = 0 THEN 'value' ELSE 'net' END AS kind, CAST(text_id % 8 * 40 AS DOUBLE) AS x0, CAST(text_id % 8 * 40 AS DOUBLE) + CASE WHEN length(str) % 4 = 0 THEN 38 ELSE 30 END AS x1,
CAST(floor(text_id / 8) * 10 AS DOUBLE) AS y, CASE WHEN page % 3 = 0 THEN 6.0 ELSE 5.0 END + text_id % 4 AS size FROM (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS doc, doc_id % 5 AS page, unnest(range(len(w))) AS text_id, unnest(w) AS str FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents) z) y WHERE str <> '')"""


def text_height(spark, sf):
    """Upper median of the text sizes of a page with at least two characters; 6 if there is none; within 1.2 and 40."""
    s = letters(spark, sf).groupBy("doc", "page").agg(F.sort_array(F.collect_list(F.when(F.length("str") >= 2, F.col("size")))).alias("s"))
    mid = F.try_element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))
    return s.select("doc", "page", F.least(F.lit(40.0), F.greatest(F.lit(1.2), F.coalesce(mid, F.lit(6.0)))).alias("height"))


def sentence_runs(spark, sf):
    """Texts that continue one another on a line become notes."""
    t = letters(spark, sf)
    return pens.with_notes(t, pens.sentence_pairs(t, ["y"])).select("doc", "page", "text_id", "kind")


def heading_pairs(spark, sf):
    """Large texts one line apart and aligned at the start, the end or the centre."""
    t = letters(spark, sf).where("size >= 7 and kind <> 'pin'").select("doc", "page", "text_id", "x0", "x1", "y", "size")

    def stacked(a, b):
        pitch, s = b["y"] - a["y"], a["size"]
        off = F.least(F.abs(a["x0"] - b["x0"]), F.abs(a["x1"] - b["x1"]), F.abs(a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2)
        return (F.abs(s - b["size"]) <= s * 0.1) & (pitch >= s * 0.9) & (pitch <= s * 1.9) & (off <= s * 0.3)

    c = F.col
    under = (c("x0") - c("size") * 0.3, c("y") + c("size") * 0.9, c("x1") + c("size") * 0.3, c("y") + c("size") * 1.9)
    j = grid_join(t, t, ["doc", "page"], under, (c("x0"), c("y"), c("x1"), c("y")), 40.0, stacked)
    return j.select("l.doc", "l.page", F.explode(F.array("l.text_id", "r.text_id")).alias("text_id")).distinct()


def style_stats(spark, sf):
    s = table(spark, sf, "segs")
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    return s.groupBy("doc", "page", "style").agg(F.count("*").alias("n"), F.sum(length).alias("len"), F.sum((length >= 40).cast("long")).alias("longish"), F.round(F.avg("width"), 6).alias("width"))


def wire_style(spark, sf):
    """The wiring style of a page: share of the length times share of long strokes is largest; ties go to the first by name."""
    s = style_stats(spark, sf)
    share = F.col("len") / F.sum("len").over(Window.partitionBy("doc", "page"))
    s = s.withColumn("score", F.round(share * (F.col("longish") + 1) / (F.col("n") + 1), 9))
    return s.groupBy("doc", "page").agg(F.min(F.struct((-F.col("score")).alias("s"), "style")).alias("b")).select("doc", "page", "b.style", (-F.col("b.s")).alias("score"))


def wire_width(spark, sf):
    """Upper median of the stroke widths of a page."""
    s = table(spark, sf, "segs").groupBy("doc", "page").agg(F.sort_array(F.collect_list("width")).alias("w"))
    return s.select("doc", "page", F.element_at("w", (F.floor(F.size("w") / 2) + 1).cast("int")).alias("width"))


def text_styles(spark, sf):
    """Styles with at least twenty strokes of a page of which 85 % are short."""
    s = table(spark, sf, "segs")
    short = (F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1")) < 60).cast("long")
    return s.groupBy("doc", "page", "style").agg(F.count("*").alias("n"), F.sum(short).alias("short")).where("n >= 20 and short >= 0.85 * n")


def marker_fonts(spark, sf):
    """Fonts in which at least three strings are markers and none is anything else."""
    t = table(spark, sf, "strings").select((F.col("k") % 41).alias("font"), F.when(F.col("k") % 41 < 20, F.concat(F.lit("PI"), F.regexp_replace("str", r"\s+", "_"))).otherwise(F.col("str")).alias("str")).where("trim(str) <> ''")
    ok = F.forall(F.split(F.trim("str"), r"\s+"), lambda w: w.rlike(MARKER))
    return t.groupBy("font").agg(F.sum(ok.cast("long")).alias("ok"), F.sum((~ok).cast("long")).alias("bad")).where("ok >= 3 and bad = 0").select("font", "ok")


def twin_text_dedupe(spark, sf):
    """Texts with the same string on the same spot count once: the first is kept. Copies are planted 0.5 and 1.5 off."""
    t = table(spark, sf, "texts").select("doc", "page", "text_id", "str", "x0", "y0", "x1", "y1", "size")
    at = lambda by, n: t.where("text_id % 4 = 1").withColumns({"text_id": F.col("text_id") + n, "x0": F.col("x0") + by, "x1": F.col("x1") + by})
    return repeats.twin_text_dedupe(t.unionByName(at(0.5, 10000)).unionByName(at(1.5, 20000))).select("doc", "page", "text_id", "str")


def dot_dedupe(spark, sf):
    """Dots within half their radius of an earlier one that stays are dropped; copies are planted 0.25 and 0.625 off."""
    d = table(spark, sf, "dots").withColumn("dot_id", F.row_number().over(Window.partitionBy("doc", "page").orderBy("x", "y")).cast("long"))
    at = lambda by, n: d.where("dot_id % 5 = 0").withColumns({"dot_id": F.col("dot_id") + n, "x": F.col("x") + by})
    return repeats.dot_dedupe(d.unionByName(at(0.25, 100000)).unionByName(at(0.625, 200000))).select("doc", "page", "dot_id", "x", "y")


def pin_dedupe(spark, sf):
    """Pins of one name within 1.5 on all sides count once; copies are planted 1 and 2 off."""
    p = table(spark, sf, "parts").select("doc", "page", F.col("i").cast("long").alias("pin_id"), "ref", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 4).alias("x1"), (F.col("y") + 2).alias("y1")).withColumnRenamed("ref", "name")
    at = lambda by, n: p.where("pin_id % 3 = 0").withColumns({"pin_id": F.col("pin_id") + n, "x0": F.col("x0") + by, "x1": F.col("x1") + by})
    return repeats.pin_dedupe(p.unionByName(at(1.0, 10000)).unionByName(at(2.0, 20000))).select("doc", "page", "pin_id", "name")


def _kept(close: str) -> str:
    """kept: rows of b without an earlier close row that stays itself; decides chains of up to five rows, which is more than the fixtures hold."""
    return f"""p AS (SELECT l.doc, l.page, l.i AS a, r.i AS z FROM b l JOIN b r ON l.doc = r.doc AND l.page = r.page AND l.i < r.i AND {close}), first AS (SELECT doc, page, i FROM b EXCEPT SELECT doc, page, z FROM p),
gone1 AS (SELECT DISTINCT p.doc, p.page, p.z FROM p JOIN first f ON p.doc = f.doc AND p.page = f.page AND p.a = f.i), open1 AS (SELECT doc, page, i FROM b EXCEPT SELECT * FROM gone1 EXCEPT SELECT * FROM first),
waits AS (SELECT DISTINCT p.doc, p.page, p.z FROM p ANTI JOIN gone1 g ON p.doc = g.doc AND p.page = g.page AND p.a = g.z), second AS (SELECT * FROM open1 EXCEPT SELECT * FROM waits),
gone AS (SELECT * FROM gone1 UNION SELECT p.doc, p.page, p.z FROM p JOIN second f ON p.doc = f.doc AND p.page = f.page AND p.a = f.i), kept AS (SELECT b.* FROM b ANTI JOIN gone g ON b.doc = g.doc AND b.page = g.page AND b.i = g.z)"""


_LINE = "(PARTITION BY doc, page, y ORDER BY x0)"
_STYLE = "st AS (SELECT doc, page, style, count(*) AS n, sum(abs(x2 - x1) + abs(y2 - y1)) AS len, count(*) FILTER (abs(x2 - x1) + abs(y2 - y1) >= 40) AS longish, round(avg(width), 6) AS width FROM segs GROUP BY doc, page, style)"

JOBS = {
    "text_height": (text_height, f"WITH {LETTERS}, s AS (SELECT doc, page, list_sort(list(size) FILTER (length(str) >= 2)) AS s FROM letters GROUP BY doc, page) SELECT doc, page, least(40.0, greatest(1.2, coalesce(s[CAST(floor(len(s) / 2) AS BIGINT) + 1], 6.0))) AS height FROM s"),
    "sentence_runs": (sentence_runs, f"""WITH {LETTERS}, a AS (SELECT *, lag(x1) OVER {_LINE} AS px, lag(size) OVER {_LINE} AS ps, lag(kind) OVER {_LINE} AS pk FROM letters), b AS (SELECT *, coalesce(x0 - px > -0.3 AND x0 - px < least(size, ps) * 0.6 AND kind <> 'pin' AND pk <> 'pin', false) AS joined FROM a),
c AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER {_LINE} AS run FROM b), d AS (SELECT *, joined AND max(CASE WHEN kind <> 'value' THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, y, run ORDER BY x0) = 1 AS pair FROM c)
SELECT doc, page, text_id, CASE WHEN pair OR coalesce(lead(pair) OVER {_LINE}, false) THEN 'note' ELSE kind END AS kind FROM d"""),
    "heading_pairs": (heading_pairs, f"""WITH {LETTERS}, t AS (SELECT * FROM letters WHERE size >= 7 AND kind <> 'pin'), p AS (SELECT a.doc, a.page, a.text_id AS i, b.text_id AS j FROM t a JOIN t b ON a.doc = b.doc AND a.page = b.page AND abs(a.size - b.size) <= a.size * 0.1 AND b.y - a.y >= a.size * 0.9 AND b.y - a.y <= a.size * 1.9
AND least(abs(a.x0 - b.x0), abs(a.x1 - b.x1), abs(a.x0 + a.x1 - b.x0 - b.x1) / 2) <= a.size * 0.3) SELECT doc, page, i AS text_id FROM p UNION SELECT doc, page, j FROM p"""),
    "style_stats": (style_stats, with_ctes(f"{_STYLE} SELECT * FROM st", "segs")),
    "wire_style": (wire_style, with_ctes(f"{_STYLE}, c AS (SELECT doc, page, style, round(len / sum(len) OVER (PARTITION BY doc, page) * (longish + 1) / (n + 1), 9) AS score FROM st) SELECT doc, page, style, score FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY score DESC, style) AS r FROM c) z WHERE r = 1", "segs")),
    "wire_width": (wire_width, with_ctes("SELECT doc, page, list_sort(list(width))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS width FROM segs GROUP BY doc, page", "segs")),
    "text_styles": (text_styles, with_ctes("SELECT doc, page, style, count(*) AS n, count(*) FILTER (abs(x2 - x1) + abs(y2 - y1) < 60) AS short FROM segs GROUP BY doc, page, style HAVING count(*) >= 20 AND count(*) FILTER (abs(x2 - x1) + abs(y2 - y1) < 60) >= 0.85 * count(*)", "segs")),
    "marker_fonts": (marker_fonts, with_ctes(f"t AS (SELECT k % 41 AS font, CASE WHEN k % 41 < 20 THEN 'PI' || regexp_replace(str, '\\s+', '_', 'g') ELSE str END AS str FROM strings), c AS (SELECT font, len(list_filter(regexp_split_to_array(trim(str), '\\s+'), lambda w: NOT regexp_matches(w, {q(MARKER)}))) = 0 AS ok FROM t WHERE trim(str) <> '') SELECT font, count(*) AS ok FROM c GROUP BY font HAVING bool_and(ok) AND count(*) >= 3", "strings")),
    "twin_text_dedupe": (twin_text_dedupe, with_ctes(f"b AS (SELECT doc, page, text_id AS i, str, x0, y0, x1, y1 FROM texts UNION ALL SELECT doc, page, text_id + 10000, str, x0 + 0.5, y0, x1 + 0.5, y1 FROM texts WHERE text_id % 4 = 1 UNION ALL SELECT doc, page, text_id + 20000, str, x0 + 1.5, y0, x1 + 1.5, y1 FROM texts WHERE text_id % 4 = 1), {_kept('l.str = r.str AND abs(l.x0 - r.x0) < 1.25 AND abs(l.y0 - r.y0) < 1.25 AND abs(l.x1 - r.x1) < 1.25 AND abs(l.y1 - r.y1) < 1.25')} SELECT doc, page, i AS text_id, str FROM kept", "texts")),
    "dot_dedupe": (dot_dedupe, with_ctes(f"d AS (SELECT doc, page, x, y, r, row_number() OVER (PARTITION BY doc, page ORDER BY x, y) AS i FROM dots), b AS (SELECT * FROM d UNION ALL SELECT doc, page, x + 0.25, y, r, i + 100000 FROM d WHERE i % 5 = 0 UNION ALL SELECT doc, page, x + 0.625, y, r, i + 200000 FROM d WHERE i % 5 = 0), {_kept('sqrt((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y)) < r.r * 0.5')} SELECT doc, page, i AS dot_id, x, y FROM kept", "dots")),
    "pin_dedupe": (pin_dedupe, with_ctes(f"b AS (SELECT doc, page, i, ref, x, y FROM parts UNION ALL SELECT doc, page, i + 10000, ref, x + 1, y FROM parts WHERE i % 3 = 0 UNION ALL SELECT doc, page, i + 20000, ref, x + 2, y FROM parts WHERE i % 3 = 0), {_kept('l.ref = r.ref AND abs(l.x - r.x) < 1.5 AND abs(l.y - r.y) < 1.5')} SELECT doc, page, i AS pin_id, ref AS name FROM kept", "parts")),
}
