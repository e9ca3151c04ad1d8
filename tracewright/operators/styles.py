"""Which strokes are lettering and which are the wiring of a page. Keyed by (doc, page); ``heights`` (doc, page, s, diag) holds the text height and the diagonal of a page. Pages without a height have no
result, empty tables give empty results, further columns are not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import color_distance, is_neutral
from .graph import KEY

STYLE = [*KEY, "style"]


def style_stats(prims: DataFrame, strokes: DataFrame, heights: DataFrame) -> DataFrame:
    """(doc, page, style, n, glyph, closed, orth_len, orth_n, color, width, fill, first): per style its primitives, those that are lettering or closed, and the level and upright strokes of those
    that do not span 0.4 of the sheet. ``prims``: doc, page, prim_id, style, color, width, fill, closed, glyph, x0, y0, x1, y1; ``strokes``: doc, page, prim_id, x1, y1, x2, y2, straight ones.
    A style is as its first primitive says; null flags count as false."""
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = (F.abs(F.col("x1") - F.col("x2")) < 0.02) | (F.abs(F.col("y1") - F.col("y2")) < 0.02)
    o = strokes.where(level).groupBy(*KEY, "prim_id").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("__len"), F.count("*").alias("__n"))
    small = prims.join(heights.select(*KEY, F.col("diag").alias("__diag")), KEY, "left").withColumn("__small", span <= F.col("__diag") * 0.4)
    p = small.join(o, [*KEY, "prim_id"], "left")
    of_small = lambda c: F.sum(F.when(F.col("__small"), F.col(c)))
    first = F.min(F.struct("prim_id", "color", "width", F.coalesce("fill", F.lit(False)).alias("fill"))).alias("f")
    j = p.groupBy(*STYLE).agg(F.count("*").alias("n"), yes("glyph").alias("glyph"), yes("closed").alias("closed"), of_small("__len").alias("orth_len"), of_small("__n").alias("orth_n"), first).fillna(0, ["orth_len", "orth_n"])
    return j.select(*STYLE, "n", "glyph", "closed", "orth_len", "orth_n", "f.color", "f.width", "f.fill", F.col("f.prim_id").alias("first"))


def text_styles(stats: DataFrame) -> DataFrame:
    """(doc, page, style): styles of at least twenty primitives of which 85 % are lettering."""
    return stats.where("n >= 20 and glyph >= 0.85 * n").select(*STYLE)


def with_strays(prims: DataFrame, lettering: DataFrame, heights: DataFrame) -> DataFrame:
    """``prims`` where those of a lettering style that are smaller than 1.2 text heights are lettering as well."""
    small = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < F.col("s") * 1.2
    j = prims.join(lettering.select(*STYLE, F.lit(True).alias("__text")), STYLE, "left").join(heights.select(*KEY, "s"), KEY, "left")
    stray = F.coalesce(F.col("__text") & small, F.lit(False))
    return j.select(*[(F.coalesce("glyph", F.lit(False)) | stray).alias("glyph") if c == "glyph" else F.col(c) for c in prims.columns])


def wiring_styles(stats: DataFrame, lettering: DataFrame, dots: DataFrame, heights: DataFrame) -> DataFrame:
    """(doc, page, style, best, score): the styles that draw the wires of a colour page, the winner (best) and those that go with it. Pages drawn in one colour, or in greys, have none.

    Among stroke styles that are not lettering, the score is the share of level and upright length, times how long the strokes are (up to three text heights each, thrice), times the open
    share (closed figures count to 80 %), five times where all junction dots (doc, page, color) have the colour, 0.6 times for greys. Strokes of the winner are over 1.5 heights long on average; ties go to
    the style drawn first. The winner's colour in a width close to its own is the same wiring.
    """
    c = F.col
    st = stats.where("not fill").join(lettering, STYLE, "left_anti").join(heights.select(*KEY, "s"), KEY)
    page = Window.partitionBy(*KEY)
    lines = st.where("orth_n > 0").withColumn("all", F.sum("orth_len").over(page))
    lines = lines.withColumns({"share": c("orth_len") / F.when(c("all") > 0, c("all")).otherwise(1.0), "mean": c("orth_len") / c("orth_n"), "grey": is_neutral(c("color"))})
    seen = c("share") > 0.03
    colours = lines.where(seen).groupBy(*KEY).agg(F.count_distinct("color").alias("colours"), F.max(~c("grey")).alias("coloured")).where("colours >= 2 and coloured").select(*KEY)
    shades = dots.where("color is not null").groupBy(*KEY, F.col("color").alias("dot")).agg(F.count("*").alias("k"))
    all_dots = dots.groupBy(*KEY).agg(F.count("*").alias("dots"))
    alike = lines.select(*STYLE, "color").join(shades, KEY).where(color_distance(c("dot"), c("color")) < 40).groupBy(*STYLE).agg(F.sum("k").alias("k"))
    lines = lines.join(colours, KEY, "left_semi").join(all_dots, KEY, "left").join(alike, STYLE, "left")
    match = F.coalesce(c("k") / c("dots"), F.lit(0.0))
    score = c("share") * F.least(c("mean") / (c("s") * 3), F.lit(3.0)) * (1 - F.least(c("closed") / c("n"), F.lit(0.8))) * (1 + 4 * match) * F.when(c("grey"), 0.6).otherwise(1.0)
    lines = lines.withColumn("score", score)
    ranked = lines.where((c("share") >= 0.02) & (c("mean") > c("s") * 1.5) & (c("score") > 0))
    best = ranked.groupBy(*KEY).agg(F.min(F.struct((-c("score")).alias("o"), "first", "style", "color", "width")).alias("b")).select(*KEY, c("b.style").alias("winner"), c("b.color").alias("b_color"), c("b.width").alias("b_width"))
    j = lines.join(best, KEY)
    near = (color_distance(c("color"), c("b_color")) < 20) & (F.abs(c("width") - c("b_width")) <= F.greatest(F.lit(0.15), c("b_width") * 0.35)) & (c("mean") > c("s"))
    return j.where((c("style") == c("winner")) | near).select(*STYLE, (c("style") == c("winner")).alias("best"), "score")
