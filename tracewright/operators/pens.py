"""Lettering pens: which pen writes labels, part fields, pin numbers and notes, and what that says about doubtful texts. All tables are keyed by (doc, page); texts without a
pen (color null) are left as they are, empty tables give empty results, further columns are kept where texts are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import LOOSE_REF, is_power_name
from ..sources.shared import written
from .graph import KEY
from .labels import attach_labels, loose_refs, pin_end_in_line, pin_under_text

PEN = [*KEY, "color"]


def sentence_pairs(texts: DataFrame, line: list[str]) -> DataFrame:
    """(doc, page, a, b): neighbours on one line (columns ``line``) that continue one another: closer than 0.6 of the smaller size, no pin among them, not two values unless a text before them in
    the same run is something else. ``texts`` (doc, page, text_id, kind, x0, x1, size)."""
    return _in_line(texts.select(*KEY, *line, "text_id", "kind", "x0", "x1", "size"), line).where("pair").select(*KEY, "a", F.col("text_id").alias("b"))


def _in_line(texts: DataFrame, line: list[str]) -> DataFrame:
    """``texts`` with the text before on their line (a) and whether the two are a pair of ``sentence_pairs``. All of it is read off one order of a line: a run has a text that is no value if
    the last of those stands at its start or after."""
    w = Window.partitionBy(*KEY, *line).orderBy("x0", "text_id")
    before = {c: F.lag(c).over(w) for c in ("x1", "size", "kind", "text_id")}
    gap = F.col("x0") - before["x1"]
    joined = (gap > -0.3) & (gap < F.least("size", before["size"]) * 0.6) & (F.col("kind") != "pin") & (before["kind"] != "pin")
    t = texts.withColumns({"joined": F.coalesce(joined, F.lit(False)), "a": before["text_id"], "at": F.row_number().over(w)})
    start, other = F.max(F.when(~F.col("joined"), F.col("at"))).over(w), F.max(F.when(F.col("kind") != "value", F.col("at"))).over(w)
    return t.withColumn("pair", F.col("joined") & F.coalesce(other >= start, F.lit(False))).drop("joined", "at")


def kinds_by_sentence(texts: DataFrame, line: list[str]) -> DataFrame:
    """``texts`` (doc, page, text_id, kind, x0, x1, size, color, columns ``line``) as ``sentence_pen_restore`` leaves the notes that ``with_notes`` makes of their ``sentence_pairs``, with kind alone changed. As a
    text's pairs are with its neighbours on the line, they are read off one order of the line, without joins. Rows without a page are left as they are."""
    w = Window.partitionBy(*KEY, *line).orderBy("x0", "text_id")
    t = _in_line(texts, line).withColumn("pair", F.col("pair") & F.col("doc").isNotNull() & F.col("page").isNotNull())
    t = t.withColumn("stays", F.when(F.col("pair"), F.coalesce(F.col("color") == F.lag("color").over(w), F.lit(True))))
    note = F.coalesce(F.greatest("stays", F.lead("stays").over(w)), F.lit(False))
    return t.withColumn("kind", F.when(note, "note").otherwise(F.col("kind"))).select(texts.columns)


def with_notes(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``texts`` with kind note for every member of a pair and its earlier kind in ``was`` (null for the others)."""
    hit = pairs.select(*KEY, F.explode(F.array("a", "b")).alias("text_id")).distinct().withColumn("__hit", F.lit(True))
    t = texts.join(hit, [*KEY, "text_id"], "left").withColumn("was", F.when(F.col("__hit"), F.col("kind")))
    return t.withColumn("kind", F.when(F.col("__hit"), "note").otherwise(F.col("kind"))).select(*texts.columns, "was")


def sentence_pen_restore(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``texts`` (doc, page, text_id, kind, was, color) with the notes undone that sentences made of words in different known pens: a text stays a note if any of its
    pairs stays, and a pair stays unless both pens are known and differ. Texts in no pair, and those that are no longer notes, are left."""
    pen = lambda n: texts.select(*KEY, F.col("text_id").alias(n), F.col("color").alias(f"pen_{n}"))
    p = pairs.join(pen("a"), [*KEY, "a"]).join(pen("b"), [*KEY, "b"])
    stays = F.coalesce(F.col("pen_a") == F.col("pen_b"), F.lit(True))
    p = p.select(*KEY, F.explode(F.array("a", "b")).alias("text_id"), stays.alias("stays")).groupBy(*KEY, "text_id").agg(F.max("stays").alias("__stays"))
    t = texts.join(p, [*KEY, "text_id"], "left")
    return t.withColumn("kind", F.when(~F.col("__stays") & (F.col("kind") == "note"), F.col("was")).otherwise(F.col("kind"))).select(texts.columns)


def pen_roles(texts: DataFrame, attached: DataFrame) -> DataFrame:
    """(doc, page, color, role): what a pen is for, as far as certain texts tell. ``texts`` (doc, page, text_id, kind, color, in_body where there is one), ``attached`` (doc, page, text_id, via).

    A label pen letters four labels on wires or more and at most a tenth as many references or notes. On pages that have one, a pen with less than a third of its labels is one of: a field pen
    (six references or more, five for each label, no fewer than notes), a pin pen (ten texts, half of them pins), a note pen (four notes, three for each reference, two for each label, no flag).
    """
    body = F.coalesce("in_body", F.lit(False)) if "in_body" in texts.columns else F.lit(False)
    t = texts.where("color is not null").select(*PEN, "text_id", "kind", body.alias("body"))
    a = attached.select(*KEY, "text_id", "via").join(t.select(*PEN, "text_id"), [*KEY, "text_id"])
    if_ = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    kind = F.col("kind")
    pens = t.groupBy(*PEN).agg(F.count("*").alias("n"), if_(kind == "pin").alias("num"), if_((kind == "component") & ~F.col("body")).alias("ref"), if_(kind == "note").alias("note"))
    marks = a.groupBy(*PEN).agg(if_(~F.col("via").isin("symbol", "ground")).alias("lab"), if_(F.col("via") == "flag").alias("flag"))
    pens = pens.join(marks, PEN, "left").fillna(0, ["lab", "flag"])
    label = (F.col("lab") >= 4) & (F.col("ref") <= F.col("lab") * 0.1) & (F.col("note") <= F.col("lab") * 0.1)
    pens = pens.withColumn("label", label)
    pens = pens.join(pens.where("label").groupBy(*KEY).agg(F.max("lab").alias("top")), KEY)
    role = F.when(F.col("label"), "label").when(F.col("lab") * 3 > F.col("top"), None).when((F.col("ref") >= 6) & (F.col("lab") * 5 <= F.col("ref")) & (F.col("ref") >= F.col("note")), "field")
    role = role.when((F.col("n") >= 10) & (F.col("num") >= F.col("n") * 0.5), "pin").when((F.col("note") >= 4) & (F.col("ref") * 3 <= F.col("note")) & (F.col("lab") * 2 <= F.col("note")) & (F.col("flag") == 0), "note")
    return pens.select(*PEN, role.alias("role")).where("role is not null")


def rekind(texts: DataFrame, roles: DataFrame) -> DataFrame:
    """``texts`` with kinds settled by their pens, the role of the pen (``role``) and whether that calls for labels to be attached again (``again``): a text in a note pen is a note unless it is a pin, a
    reference in a label pen is a net, references and values in a pin pen are pins. Texts that a net link names (linked, where there is such a column) stay."""
    t = texts.drop("role", "again").join(roles.select(*PEN, "role"), PEN, "left")
    linked = F.coalesce("linked", F.lit(False)) if "linked" in texts.columns else F.lit(False)
    kind = F.col("kind")
    to_note = (F.col("role") == "note") & ~kind.isin("note", "pin")
    new = F.when(linked, kind).when(to_note, "note").when((F.col("role") == "label") & (kind == "component"), "net").when((F.col("role") == "pin") & kind.isin("component", "value"), "pin").otherwise(kind)
    t = t.withColumn("new", new).withColumn("again", F.coalesce((F.col("new") != kind) & F.col("role").isin("note", "label"), F.lit(False)))
    return t.select(*[F.col("new").alias("kind") if c == "kind" else F.col(c) for c in texts.drop("role", "again").columns], "role", "again")


def settled_labels(texts: DataFrame, segs: DataFrame, symbols: DataFrame, flags: DataFrame, touch: float = 0.6, monochrome: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, attached): ``texts`` as ``rekind`` leaves them, and ``attach_labels`` after the pens are known. Labels are attached once on all pages and again only on those where a kind changed or
    a pen letters fields or pins; other pages keep the first result. Both the first result and the settled texts are written, as they are read several times; give ``texts`` as a table, too."""
    first = written(attach_labels(texts, segs, symbols, flags, touch, monochrome), "labels")
    settled = written(rekind(texts, pen_roles(texts, first)), "settled")
    pages = settled.where("again or role in ('field', 'pin')").select(*KEY).distinct()
    on = lambda df: df.join(pages, KEY, "left_semi")
    second = attach_labels(on(settled), on(segs), on(symbols), on(flags), touch, monochrome)
    return settled, first.join(pages, KEY, "left_anti").unionByName(second)


def loose_refs_by_pen(texts: DataFrame, lines: DataFrame, field_pens: DataFrame, pin_pens: DataFrame) -> DataFrame:
    """(doc, page, text_id): words outside bodies that name no wire, look like references and have a value beside them (``loose_refs``) or are lettered in a field pen (doc, page, color) with no pin line
    (lines) ending at them. Not those in a pin pen, which writes numbers such as A12, nor on a pin line by more than half their length. ``texts``: also color, in_body, net_id."""
    pen = lambda p: p.select(*PEN).distinct()
    t = texts.where((F.col("kind") == "net") & F.col("net_id").isNull() & ~F.coalesce("in_body", F.lit(False)) & F.col("str").rlike(LOOSE_REF) & ~is_power_name(F.col("str")))
    t = t.join(pen(pin_pens), PEN, "left_anti").join(pin_under_text(t, lines).where("cover > 0.5"), [*KEY, "text_id"], "left_anti")
    fields = t.join(pen(field_pens), PEN, "left_semi")
    fields = fields.join(pin_end_in_line(fields, lines), [*KEY, "text_id"], "left_anti").select(*KEY, "text_id")
    return loose_refs(texts).join(t.select(*KEY, "text_id"), [*KEY, "text_id"], "left_semi").union(fields).distinct()
