"""Items that are drawn or written twice: the first of those on one spot stays, and only those that stay are compared with later ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import KEY, dropped_repeats
from .spatial import grid_join, point_box, text_box


def _without(items: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    links = pairs.select("l.doc", "l.page", F.col(f"l.{id_col}").alias("earlier"), F.col(f"r.{id_col}").alias("later"))
    return items.join(dropped_repeats(links).withColumnRenamed("later", id_col), [*KEY, id_col], "left_anti")


def _edges_close(l, r, tol: Column) -> Column:  # noqa: E741
    return F.greatest(*[F.abs(l[c] - r[c]) for c in ("x0", "y0", "x1", "y1")]) < tol


def twin_text_dedupe(texts: DataFrame, cell: float = 20.0) -> DataFrame:
    """``texts`` (doc, page, text_id, str, x0, y0, x1, y1, size) without those that repeat an earlier one's string with all edges within max(0.3, a quarter of
    their size). Texts without a string or a box repeat nothing; an empty table stays empty."""
    tol = lambda r: F.greatest(F.lit(0.3), r["size"] * 0.25)
    t = texts.select(*KEY, "text_id", "str", "x0", "y0", "x1", "y1", "size").dropna()
    corner = point_box("x0", "y0", F.greatest(F.lit(0.3), F.col("size") * 0.25))
    pairs = grid_join(t, t, KEY, point_box("x0", "y0"), corner, cell, lambda l, r: (l["str"] == r["str"]) & (l["text_id"] < r["text_id"]) & _edges_close(l, r, tol(r)))  # noqa: E741
    return _without(texts, "text_id", pairs)


def dot_dedupe(dots: DataFrame, cell: float = 20.0) -> DataFrame:
    """``dots`` (doc, page, dot_id, x, y, r) without those closer than half their own radius to an earlier one."""
    d = dots.select(*KEY, "dot_id", "x", "y", "r").dropna()
    pairs = grid_join(d, d, KEY, point_box(), point_box(grow=F.col("r") * 0.5), cell, lambda l, r: (l["dot_id"] < r["dot_id"]) & (F.hypot(l["x"] - r["x"], l["y"] - r["y"]) < r["r"] * 0.5))  # noqa: E741
    return _without(dots, "dot_id", pairs)


def pin_dedupe(pins: DataFrame, tol: float = 1.5, cell: float = 20.0) -> DataFrame:
    """``pins`` (doc, page, pin_id, name, x0, y0, x1, y1) without those that repeat an earlier one's name with all edges within ``tol``."""
    p = pins.select(*KEY, "pin_id", "name", "x0", "y0", "x1", "y1").dropna()
    pairs = grid_join(p, p, [*KEY, "name"], text_box(), text_box(tol), cell, lambda l, r: (l["pin_id"] < r["pin_id"]) & _edges_close(l, r, F.lit(tol)))  # noqa: E741
    return _without(pins, "pin_id", pairs)
