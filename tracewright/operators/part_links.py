"""Links that a CAD program puts around parts and net labels: which references and values they state, and what that makes of the texts inside. All tables are keyed by (doc, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_rules import classify_text
from .graph import KEY
from .labels import BOX, link_best_text
from .spatial import grid_join, text_box

CELL = 20.0
#: Linked labels, parts or chained links of a page from which its links are trusted; lines of a small part.
ENOUGH, LINES = 3, 4


def _same_cells(t, b, c: Column) -> Column:
    """A text and a box share a cell of width ``c``."""
    cell = lambda v: F.floor(v / c)
    return (cell(t["x1"]) >= cell(b["x0"])) & (cell(t["x0"]) <= cell(b["x1"])) & (cell(t["y1"]) >= cell(b["y0"])) & (cell(t["y0"]) <= cell(b["y1"]))


def part_link_rows(links: DataFrame, texts: DataFrame, heights: DataFrame) -> DataFrame:
    """(doc, page, link_id, x0, y0, x1, y1, ref, values, has_text): the links of parts that name a reference. ``links`` (doc, page, link_id, x0, y0, x1, y1, text, ref_prop, value_prop) hold what a link's
    note says, in lines, and what its script says, if there is one.

    The reference is the script's if it looks like one, else the first line that is a reference and is written in cells the box covers (of width max(4, 2 s)). The value is the script's, else in links of up
    to four lines every other line that is written there; links of more lines list their pins. Links with neither lines nor properties, and pages without a height, give nothing; null texts match nothing.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    prop = F.when(F.col("ref_prop").rlike(r"(?i)^[A-Z][\w-]{0,15}$"), F.col("ref_prop"))
    l = links.join(heights.select(*KEY, F.greatest(F.lit(4.0), F.col("s") * 2).alias("cell")), KEY)  # noqa: E741
    l = l.select(*KEY, "link_id", *BOX, "cell", lines.alias("lines"), prop.alias("prop"), F.when(F.col("value_prop") != "", F.col("value_prop")).alias("val"), (F.col("ref_prop").isNotNull() | F.col("value_prop").isNotNull()).alias("props"))  # noqa: E741
    l = l.where((F.size("lines") > 0) | F.col("props")).drop("props")  # noqa: E741
    t = texts.select(*KEY, "str", *BOX)
    wanted = lambda a, b: _same_cells(b, a, a["cell"]) & (F.array_contains(a["lines"], b["str"]) | F.coalesce(b["str"] == a["prop"], F.lit(False)))
    reach = tuple(F.col(c) + F.col("cell") * (1 if k > 1 else -1) for k, c in enumerate(BOX))
    inside = grid_join(l, t, KEY, reach, text_box(), CELL, wanted).select("l.doc", "l.page", "l.link_id", "r.str").groupBy(*KEY, "link_id").agg(F.collect_set("str").alias("inside"))
    l = l.join(inside, [*KEY, "link_id"], "left").withColumn("inside", F.coalesce("inside", F.array().cast("array<string>")))  # noqa: E741
    written = F.filter("lines", lambda s: (classify_text(s) == "component") & F.array_contains("inside", s))
    l = l.withColumn("ref", F.coalesce("prop", F.try_element_at(written, F.lit(1)))).where("ref is not null")  # noqa: E741
    values = F.when(F.col("val").isNotNull(), F.array("val")).when(F.size("lines") <= LINES, F.filter("lines", lambda s: (s != F.col("ref")) & F.array_contains("inside", s))).otherwise(F.array().cast("array<string>"))
    return l.select(*KEY, "link_id", *BOX, "ref", values.alias("values"), F.array_contains("inside", F.col("ref")).alias("has_text"))


def trusted(parts: DataFrame, nets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, parts, labels): the pages whose links are trusted (doc, page, labels: number of linked labels), the part links on them, and the texts that their net links name (doc, page, text_id). ``nets`` (doc,
    page, link_id, x0, y0, x1, y1, chained). A page needs ENOUGH linked labels, part links or net links that lead to another place (chained)."""
    labels = link_best_text(nets, texts).select(*KEY, "text_id").distinct()
    count = lambda df, n: df.groupBy(*KEY).agg(F.count("*").alias(n))
    pages = count(labels, "labels").join(count(parts, "parts"), KEY, "full_outer").join(count(nets.where("chained"), "chained"), KEY, "full_outer").fillna(0)
    pages = pages.where(f"labels >= {ENOUGH} or parts >= {ENOUGH} or chained >= {ENOUGH}").select(*KEY, "labels")
    return pages, parts.join(pages, KEY, "left_semi"), labels.join(pages, KEY, "left_semi")


def rekind_by_links(texts: DataFrame, pages: DataFrame, parts: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts`` (doc, page, text_id, str, kind, x0, y0, x1, y1) with the kinds that trusted links (as ``trusted`` gives them) state, ``linked`` and ``in_body``: linked texts are nets; on pages with ENOUGH of them other nets are
    notes; a text with its centre in a part's box is its reference, its value, or else in the body, where references and nets are pins. Boxes count in the order of link_id: the last one that
    names a text decides, and a later body makes a reference a pin. Other pages are left as they are."""
    given = F.coalesce("in_body", F.lit(False)) if "in_body" in texts.columns else F.lit(False)
    t = texts.withColumn("in_body", given).join(pages, KEY, "left").join(labels.withColumn("linked", F.lit(True)), [*KEY, "text_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    kind = F.when(F.col("linked"), "net").when((F.col("labels") >= ENOUGH) & (F.col("kind") == "net"), "note").otherwise(F.col("kind"))
    centre = lambda a, b: ((a["x0"] + a["x1"]) / 2 >= b["x0"]) & ((a["x0"] + a["x1"]) / 2 <= b["x1"]) & ((a["y0"] + a["y1"]) / 2 >= b["y0"]) & ((a["y0"] + a["y1"]) / 2 <= b["y1"])
    free = t.where(~F.col("linked")).select(*KEY, "text_id", "str", *BOX)
    j = grid_join(free, parts.select(*KEY, "link_id", "ref", "values", *BOX), KEY, text_box(), text_box(), CELL, centre)
    says = F.when(F.col("l.str") == F.col("r.ref"), "component").when(F.array_contains("r.values", F.col("l.str")), "value")
    j = j.select("l.doc", "l.page", "l.text_id", "r.link_id", says.alias("says"))
    named = j.groupBy(*KEY, "text_id").agg(F.max(F.when(F.col("says").isNotNull(), F.struct("link_id", "says"))).alias("last"), F.max(F.when(F.col("says").isNull(), F.col("link_id"))).alias("body"))
    out = t.withColumn("kind", kind).join(named, [*KEY, "text_id"], "left")
    later = F.col("body").isNotNull() & (F.col("last").isNull() | (F.col("body") > F.col("last.link_id")))
    now = F.coalesce("last.says", "kind")
    now = F.when(F.coalesce(later, F.lit(False)) & now.isin("component", "net"), "pin").otherwise(now)
    cols = [c for c in texts.columns if c not in ("kind", "in_body", "linked")]
    return out.select(*cols, now.alias("kind"), (F.col("in_body") | F.col("body").isNotNull()).alias("in_body"), "linked")


def components_with_links(components: DataFrame, parts: DataFrame) -> DataFrame:
    """``components`` (doc, page, ref, values) as the trusted part links complete them: a link that states values replaces those read from the drawing, later links win; a reference that is not written
    as text anywhere in its box is a part of its own, from the first such link on."""
    l = parts.groupBy(*KEY, "ref").agg(F.min(F.when(~F.col("has_text"), F.col("link_id"))).alias("born"), F.max(F.when(F.size("values") > 0, F.struct("link_id", "values"))).alias("last"))  # noqa: E741
    j = components.select(*KEY, "ref", F.col("values").alias("read")).withColumn("drawn", F.lit(True)).join(l, [*KEY, "ref"], "full_outer").where("drawn or born is not null")
    stated = F.when(F.col("drawn") | (F.col("last.link_id") >= F.col("born")), F.col("last.values"))
    return j.select(*KEY, "ref", F.coalesce(stated, "read", F.array().cast("array<string>")).alias("values"), F.coalesce(~F.col("drawn"), F.lit(True)).alias("from_link"))
