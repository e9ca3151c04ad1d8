"""Queries that apply column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text_rules as R
from ..sources.fixtures import table, with_ctes
from .oracle import dist, gap, natural, power, q


# Stated apart from the rules, so that a slip in one shows.
PART = "^[A-Z0-9]+([-/.][A-Z0-9().#]+)+$|^[A-Z][A-Z]+[0-9][0-9]+[A-Z0-9/#-]*$"


def kinds(s: str) -> str:
    i = lambda p: q("(?i)" + p)
    m = lambda p: f"regexp_matches({s}, {p})"
    return f"""CASE WHEN {s} = '' THEN 'note' WHEN {m(q(chr(94) + '[0-9]{1,4}$'))} THEN 'pin' WHEN {m(q('^[AB][0-9]{1,2}$'))} THEN 'pin' WHEN upper({s}) = 'PWR_FLAG' THEN 'note'
WHEN {power(s)} THEN 'net' WHEN {m(i(R.VALUE))} THEN 'value' WHEN {m(q('[ ]'))} THEN 'note' WHEN {m(i(R.NOTE))} THEN 'note'
WHEN len(string_split({s}, '/')) >= 3 AND len(list_filter(string_split({s}, '/'), lambda x: regexp_matches(x, {q(R.SPEC_FIELD)}))) >= 2 THEN 'value'
WHEN {m(q(R.WORD_REF))} THEN 'net' WHEN starts_with({s}, '*') THEN 'component' WHEN {m(q(R.REFDES))} THEN 'component' WHEN {m(q(R.CONNECTOR))} THEN 'component'
WHEN {m(q(PART))} AND NOT contains({s}, '_') AND NOT {m(i(R.SIGNAL))} THEN 'value' WHEN {m(i(R.PART_PAREN))} AND NOT regexp_matches(split_part({s}, '(', 1), '[\\\\/]') THEN 'value'
WHEN length({s}) < 2 THEN 'pin' WHEN NOT {m(q('[A-Za-z]'))} THEN 'note' ELSE 'net' END"""


def classify_text(spark, sf):
    s = table(spark, sf, "strings")
    return s.select("k", "str", R.classify_text(F.col("str")).alias("kind"))


def classify_tokens(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("str"))
    words = words.groupBy("str").agg(F.count("*").alias("n"))
    return words.groupBy(R.classify_text(F.col("str")).alias("kind")).agg(F.count("*").alias("words"), F.sum("n").alias("uses"))


def is_power_name(spark, sf):
    return table(spark, sf, "strings").groupBy("str").agg(F.count("*").alias("n")).select("str", "n", R.is_power_name(F.col("str")).alias("power"))


def is_spec_list(spark, sf):
    return table(spark, sf, "strings").select("k", R.is_spec_list(F.col("str")).alias("spec"))


def plain_name(spark, sf):
    marked = F.concat(F.lit("~{A"), F.col("k").cast("string"), F.lit("}{slash}"), F.col("str"), F.lit("{backslash}"))
    both = table(spark, sf, "strings").select("k", F.when(F.col("k") % 2 == 0, marked).otherwise(F.concat(F.lit("~"), F.col("str"))).alias("raw"))
    return both.select("k", R.plain_name(F.col("raw")).alias("name"))


def strip_count(spark, sf):
    s = table(spark, sf, "strings").select("k", F.when(F.col("k") % 3 == 0, F.concat("str", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("str")).alias("title"))
    return s.select("k", R.strip_count(F.col("title")).alias("title"))


def gate_base(spark, sf):
    return table(spark, sf, "strings").select("k", R.gate_base(F.col("str")).alias("base"))


def match_rank(spark, sf):
    s = table(spark, sf, "strings")
    terms = spark.createDataFrame([("r1",), ("u",), ("SIG_9",), ("3v",)], "query string")
    j = s.crossJoin(F.broadcast(terms))  # a stated set of four searches
    return j.select("query", "k", R.match_rank(F.col("str"), F.col("query")).alias("rank")).where("rank is not null").groupBy("query", "rank").agg(F.count("*").alias("hits"), F.min("k").alias("first"))


def natural_sort_key(spark, sf):
    s = table(spark, sf, "strings").select("str").distinct()
    return s.select("str", R.natural_key(F.col("str")).alias("key"))


def csv_cell(spark, sf):
    s = table(spark, sf, "strings").select("k", F.when(F.col("k") % 5 == 0, F.concat("str", F.lit(',"x"'))).otherwise(F.col("str")).alias("str"))
    return s.select("k", R.csv_cell(F.col("str")).alias("cell"))


def marker_words(spark, sf):
    """Marker strings split into typed words with their character span; glued pins are parted."""
    glued = F.concat(F.lit("PIU"), (F.col("k") % 9).cast("string"), F.lit("0"), (F.col("k") % 5).cast("string"), F.lit("PIR"), (F.col("k") % 7).cast("string"), F.lit("01 COC"), (F.col("k") % 4).cast("string"), F.lit(" x NLNET"), (F.col("k") % 6).cast("string"))
    s = table(spark, sf, "strings").select("k", glued.alias("str"))
    # a blank before every PI<letter> inside a word starting with PI; the pieces' lengths give the spans
    pieces = F.regexp_extract_all("str", F.lit(r"PI[A-Z](?:(?!PI[A-Z])\S)*|\S+|\s+"), F.lit(0))
    s = s.select("k", F.posexplode(pieces).alias("i", "w"), pieces.alias("all"))
    start = F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
    s = s.select("k", "w", start.alias("start")).where(F.col("w").rlike(R.MARKER))
    kind = F.when(F.col("w").startswith("PI"), "pin").when(F.col("w").startswith("CO"), "part").when(F.col("w").startswith("NL"), "netLabel").otherwise("port")
    return s.select("k", kind.alias("kind"), F.substring("w", 3, 1000).alias("code"), "start", (F.col("start") + F.length("w")).alias("stop"))


def link_props(spark, sf):
    """Key=value pairs of a popup script as a sorted list; keys of rules are dropped, of equal keys the last counts."""
    script = F.concat(F.lit("popUpMenu('Rules.x=1','Ref = U"), F.col("k").cast("string"), F.lit("','Value=10k ','"), F.col("str"), F.lit("=1','Ref=R"), (F.col("k") % 9).cast("string"), F.lit("')"))
    s = table(spark, sf, "strings").select("k", script.alias("js"))
    keys = F.transform(F.regexp_extract_all("js", F.lit("'([^'=]{1,60})=([^']*)'"), F.lit(1)), lambda x: F.trim(x))
    vals = F.transform(F.regexp_extract_all("js", F.lit("'([^'=]{1,60})=([^']*)'"), F.lit(2)), lambda x: F.trim(x))
    pairs = F.filter(F.arrays_zip(keys.alias("a"), vals.alias("b")), lambda p: ~F.startswith(p["a"], F.lit("Rules.")))
    s = s.select("k", F.posexplode(pairs).alias("i", "p")).groupBy("k", F.col("p.a").alias("key")).agg(F.max_by("p.b", "i").alias("value"))
    return s.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))), ";").alias("props"))


def dist_point_seg(spark, sf):
    j = table(spark, sf, "segs").alias("s").join(table(spark, sf, "dots").alias("d"), ["doc", "page"])
    return j.groupBy("doc", "page", "seg_id").agg(F.round(F.min(G.dist_point_seg("d.x", "d.y", "s.x1", "s.y1", "s.x2", "s.y2")), 6).alias("nearest"))


def dist_box_seg(spark, sf):
    s = table(spark, sf, "segs").withColumns({"x2": F.col("x2") + F.when(F.col("seg_id") % 3 == 0, F.lit(8.0)).otherwise(0.0), "y2": F.col("y2") + F.when(F.col("seg_id") % 3 == 0, F.lit(16.0)).otherwise(0.0)})
    b = tuple(F.lit(float(v)) for v in (100, 100, 160, 140))
    return s.select("doc", "page", "seg_id", F.round(G.dist_box_seg(b, "x1", "y1", "x2", "y2"), 6).alias("d"))


def box_gap(spark, sf):
    t = table(spark, sf, "texts")
    a, b = (t.select("doc", "page", F.col("text_id").alias(f"{n}id"), *[F.col(c).alias(f"{n}{c}") for c in ("x0", "y0", "x1", "y1")]) for n in "ab")
    j = a.join(b, (a["doc"] == b["doc"]) & (a["page"] == b["page"]) & (F.col("bid") == F.col("aid") + 1))
    return j.select(a["doc"], a["page"], "aid", F.round(G.box_gap(("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")), 6).alias("gap"))


def affine_apply(spark, sf):
    s = table(spark, sf, "segs")
    turn = F.when(F.col("seg_id") % 2 == 0, F.array(*[F.lit(float(v)) for v in (0, 1, -1, 0, 5, 7)])).otherwise(F.array(*[F.lit(float(v)) for v in (2, 0, 0, 2, -1, 3)]))
    flip = F.array(*[F.lit(float(v)) for v in (1, 0, 0, -1, 0, 842)])
    x, y = G.affine_apply(G.affine_compose(flip, turn), "x1", "y1")
    return s.select("doc", "page", "seg_id", x.alias("x"), y.alias("y"))


def color_distance(spark, sf):
    hexed = lambda n: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("k") * n % 16777216)), 6, "0"))
    s = table(spark, sf, "strings").select("k", hexed(7919).alias("a"), hexed(104729).alias("b"))
    return s.select("k", G.color_distance(F.col("a"), F.col("b")).alias("d"), G.is_neutral(F.col("a")).alias("grey"))


def style_key(spark, sf):
    """Stroke style as text: paint, colour in lower case, width to two decimals."""
    s = table(spark, sf, "segs")
    key = F.format_string("%s%s/%.2f", F.when(F.col("seg_id") % 4 == 0, "f").otherwise("s"), F.lower("style"), F.col("width"))
    return s.groupBy(key.alias("style")).agg(F.count("*").alias("n"))


CELL = r"""CASE WHEN regexp_matches(s, '^[=+\-@]') THEN '"=""' || replace(s, '"', '""' || '""') || '"' || '""' WHEN regexp_matches(s, '[",\r\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END"""
_RAW = "CASE WHEN k % 2 = 0 THEN '~{A' || k || '}{slash}' || str || '{backslash}' ELSE '~' || str END"
_GLUED = "'PIU' || k % 9 || '0' || k % 5 || 'PIR' || k % 7 || '01 COC' || k % 4 || ' x NLNET' || k % 6"
_SCRIPT = "'popUpMenu(''Rules.x=1'',''Ref = U' || k || ''',''Value=10k '',''' || str || '=1'',''Ref=R' || k % 9 || ''')'"
_HEX = lambda c: f"CAST(('0x' || {c}) AS INTEGER)"
_CH = lambda n: [f"CAST(floor((k * {n} % 16777216) / {d}) AS BIGINT) % 256" for d in (65536, 256, 1)]

JOBS = {
    "classify_text": (classify_text, with_ctes(f"c AS (SELECT k, str, trim(str) AS s FROM strings) SELECT k, str, {kinds('s')} AS kind FROM c", "strings")),
    "classify_tokens": (classify_tokens, f"WITH w AS (SELECT str, trim(str) AS s, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS str FROM documents) t GROUP BY str) SELECT {kinds('s')} AS kind, count(*) AS words, CAST(sum(n) AS BIGINT) AS uses FROM w GROUP BY 1"),
    "is_power_name": (is_power_name, with_ctes(f"SELECT str, count(*) AS n, {power('str')} AS power FROM strings GROUP BY str", "strings")),
    "is_spec_list": (is_spec_list, with_ctes(f"SELECT k, len(string_split(str, '/')) >= 3 AND len(list_filter(string_split(str, '/'), lambda x: regexp_matches(x, {q(R.SPEC_FIELD)}))) >= 2 AS spec FROM strings", "strings")),
    "plain_name": (plain_name, with_ctes(f"SELECT k, regexp_replace(regexp_replace(replace(replace({_RAW}, '{{slash}}', '/'), '{{backslash}}', '\\'), '[~^_]\\{{([^}}]*)\\}}', '\\1', 'g'), '^~', '') AS name FROM strings", "strings")),
    "strip_count": (strip_count, with_ctes("SELECT k, regexp_replace(CASE WHEN k % 3 = 0 THEN str || ' (' || k || ')' ELSE str END, '\\s*\\(\\d+\\)\\s*$', '') AS title FROM strings", "strings")),
    "gate_base": (gate_base, with_ctes("SELECT k, CASE WHEN regexp_matches(ltrim(str, '*'), '^[A-Z]+\\d{1,4}[A-H]$') THEN left(ltrim(str, '*'), -1) END AS base FROM strings", "strings")),
    "match_rank": (match_rank, with_ctes("m AS (SELECT query, k, CASE WHEN upper(str) = upper(query) THEN 0 WHEN starts_with(upper(str), upper(query)) THEN 1 WHEN contains(upper(str), upper(query)) THEN 2 END AS rank FROM strings, (VALUES ('r1'), ('u'), ('SIG_9'), ('3v')) v(query)) SELECT query, rank, count(*) AS hits, min(k) AS first FROM m WHERE rank IS NOT NULL GROUP BY query, rank", "strings")),
    "natural_sort_key": (natural_sort_key, with_ctes(f"SELECT DISTINCT str, {natural('str')} AS key FROM strings", "strings")),
    "csv_cell": (csv_cell, with_ctes("c AS (SELECT k, CASE WHEN k % 5 = 0 THEN str || ',\"x\"' ELSE str END AS s FROM strings) SELECT k, " + CELL + " AS cell FROM c", "strings")),
    "marker_words": (marker_words, with_ctes(f"""m AS (SELECT k, CAST(k % 9 AS STRING) AS a, CAST(k % 5 AS STRING) AS b, CAST(k % 7 AS STRING) AS c, CAST(k % 4 AS STRING) AS d, CAST(k % 6 AS STRING) AS e FROM strings)
SELECT k, 'pin' AS kind, 'U' || a || '0' || b AS code, 0 AS start, 6 AS stop FROM m UNION ALL SELECT k, 'pin', 'R' || c || '01', 6, 12 FROM m UNION ALL SELECT k, 'part', 'C' || d, 13, 17 FROM m UNION ALL SELECT k, 'netLabel', 'NET' || e, 20, 26 FROM m""", "strings")),
    "link_props": (link_props, with_ctes(f"""p AS (SELECT k, unnest(regexp_extract_all({_SCRIPT}, '''([^''=]{{1,60}})=([^'']*)''', 1)) AS a, unnest(regexp_extract_all({_SCRIPT}, '''([^''=]{{1,60}})=([^'']*)''', 2)) AS b, generate_subscripts(regexp_extract_all({_SCRIPT}, '''([^''=]{{1,60}})=([^'']*)''', 1), 1) AS i FROM strings),
l AS (SELECT k, trim(a) AS key, arg_max(trim(b), i) AS value FROM p WHERE NOT starts_with(trim(a), 'Rules.') GROUP BY k, trim(a)) SELECT k, array_to_string(list_sort(list(key || '=' || value)), ';') AS props FROM l GROUP BY k""", "strings")),
    "dist_point_seg": (dist_point_seg, with_ctes(f"SELECT s.doc, s.page, s.seg_id, round(min({dist('d.x', 'd.y', 's.x1', 's.y1', 's.x2', 's.y2')}), 6) AS nearest FROM segs s JOIN dots d ON s.doc = d.doc AND s.page = d.page GROUP BY s.doc, s.page, s.seg_id", "segs", "dots")),
    "dist_box_seg": (dist_box_seg, with_ctes(f"""m AS (SELECT doc, page, seg_id, x1, y1, x2 + CASE WHEN seg_id % 3 = 0 THEN 8 ELSE 0 END AS x2, y2 + CASE WHEN seg_id % 3 = 0 THEN 16 ELSE 0 END AS y2 FROM segs)
SELECT doc, page, seg_id, round(CASE WHEN abs(x1 - x2) > 0.05 AND abs(y1 - y2) > 0.05 THEN least({', '.join(gap((100, 100, 160, 140), (f'(x1 + (x2 - x1) * {k / 8})', f'(y1 + (y2 - y1) * {k / 8})') * 2) for k in range(9))})
ELSE {gap((100, 100, 160, 140), ('least(x1, x2)', 'least(y1, y2)', 'greatest(x1, x2)', 'greatest(y1, y2)'))} END, 6) AS d FROM m""", "segs")),
    "box_gap": (box_gap, with_ctes(f"SELECT a.doc, a.page, a.text_id AS aid, round({gap(('a.x0', 'a.y0', 'a.x1', 'a.y1'), ('b.x0', 'b.y0', 'b.x1', 'b.y1'))}, 6) AS gap FROM texts a JOIN texts b ON a.doc = b.doc AND a.page = b.page AND b.text_id = a.text_id + 1", "texts")),
    "affine_apply": (affine_apply, with_ctes("SELECT doc, page, seg_id, CASE WHEN seg_id % 2 = 0 THEN 5 - y1 ELSE 2 * x1 - 1 END AS x, 842 - CASE WHEN seg_id % 2 = 0 THEN x1 + 7 ELSE 2 * y1 + 3 END AS y FROM segs", "segs")),
    "color_distance": (color_distance, with_ctes(f"SELECT k, CAST({' + '.join(f'abs({a} - {b})' for a, b in zip(_CH(7919), _CH(104729), strict=True))} AS INTEGER) AS d, greatest({', '.join(_CH(7919))}) - least({', '.join(_CH(7919))}) < 24 AS grey FROM strings", "strings")),
    "style_key": (style_key, with_ctes("SELECT CASE WHEN seg_id % 4 = 0 THEN 'f' ELSE 's' END || lower(style) || '/' || printf('%.2f', width) AS style, count(*) AS n FROM segs GROUP BY 1", "segs")),
}
