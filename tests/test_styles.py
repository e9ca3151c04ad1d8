"""Styles of strokes and scores of names and pins: worked examples, ties, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import scores, styles

KEY = "doc long, page long"
PRIM = f"{KEY}, prim_id long, style string, color string, width double, fill boolean, closed boolean, glyph boolean, x0 double, y0 double, x1 double, y1 double"
LINE = f"{KEY}, prim_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def heights(spark):
    return spark.createDataFrame([(1, 0, 5.0, 500.0), (1, 1, 5.0, 500.0)], f"{KEY}, s double, diag double")


def page(spark, rows, at=0):
    """rows: style, colour, width, length, how many, flags."""
    prims, strokes = [], []
    for style, color, width, length, n, *flags in rows:
        for _ in range(n):
            i = len(prims)
            prims.append((1, at, i, style, color, width, "fill" in flags, "closed" in flags or None, "glyph" in flags, 0.0, 10.0 * i, float(length), 10.0 * i))
            strokes.append((1, at, i, 0.0, 10.0 * i, float(length), 10.0 * i))
    return spark.createDataFrame(prims, PRIM), spark.createDataFrame(strokes, LINE)


def wiring(spark, heights, rows, dots=()):
    prims, strokes = page(spark, rows)
    stats = styles.style_stats(prims, strokes, heights)
    got = styles.wiring_styles(stats, styles.text_styles(stats), spark.createDataFrame([(1, 0, c) for c in dots], f"{KEY}, color string"), heights)
    return {r["style"]: r["best"] for r in got.collect()}


def test_dots_and_long_strokes_show_the_wiring(spark, heights):
    rows = [("a", "#00aa00", 0.5, 40, 10), ("b", "#aa0000", 0.5, 40, 10), ("c", "#00aa04", 0.6, 20, 2), ("d", "#00aa00", 2.0, 30, 2), ("e", "#222222", 0.3, 60, 5)]
    assert wiring(spark, heights, rows, ["#aa0000"] * 3) == {"b": True}
    assert wiring(spark, heights, rows, ["#00aa00", None]) == {"a": True, "c": False}
    assert wiring(spark, heights, rows) == {"a": True, "c": False}  # equal scores: the style drawn first


def test_pages_in_one_colour_have_no_wiring_style(spark, heights):
    assert wiring(spark, heights, [("a", "#00aa00", 0.5, 40, 10), ("b", "#00aa00", 1.5, 40, 10)]) == {}
    assert wiring(spark, heights, [("a", "#222222", 0.5, 40, 10), ("b", "#777777", 0.5, 40, 10)]) == {}
    assert wiring(spark, heights, [("a", "#00aa00", 0.5, 4, 10), ("b", "#aa0000", 0.5, 4, 10)]) == {}  # all too short
    assert wiring(spark, heights, [("a", "#00aa00", 0.5, 40, 10, "fill"), ("b", "#aa0000", 0.5, 40, 10)]) == {}
    assert wiring(spark, heights, []) == {}


def test_lettering_styles(spark, heights):
    prims, strokes = page(spark, [("t", "#00aa00", 0.2, 4, 18, "glyph"), ("t", "#00aa00", 0.2, 4, 1), ("t", "#00aa00", 0.2, 9, 2), ("u", "#00aa00", 0.2, 4, 19, "glyph"), ("w", "#00aa00", 0.2, 300, 1)])
    stats = styles.style_stats(prims, strokes, heights)
    assert {(r["style"], r["n"], r["glyph"], r["orth_n"]) for r in stats.collect()} == {("t", 21, 18, 21), ("u", 19, 19, 19), ("w", 1, 0, 0)}
    lettering = styles.text_styles(stats)
    assert [r["style"] for r in lettering.collect()] == ["t"]
    assert styles.with_strays(prims, lettering, heights).where("glyph").count() == 38  # the short stray, not the two long ones


def test_names_of_true_nets(spark):
    cells = spark.createDataFrame([(1, 0, 5, 1, 10.0), (1, 0, 6, 1, 10.0), (1, 0, 7, 2, 50.0), (1, 0, 8, 3, 4.0), (1, 0, 7, 3, 1.0)], f"{KEY}, net long, gt_net long, len double")
    truth = spark.createDataFrame([(1, 0, 1, 20.0), (1, 0, 2, 30.0), (1, 0, 2, 20.0), (1, 0, 3, 4.0), (1, 0, 4, 9.0), (1, 0, 9, 2.0)], f"{KEY}, net long, len double")
    names = spark.createDataFrame([(1, 0, 1, 0, "gnd"), (1, 0, 2, 0, "A"), (1, 0, 2, 1, "B"), (1, 0, 4, 0, "C"), (1, 0, 3, 0, None)], f"{KEY}, gt_net long, place int, name string")
    called = spark.createDataFrame([(1, 0, 5, "GND"), (1, 0, 6, "X"), (1, 0, 7, "b"), (1, 0, 8, None)], f"{KEY}, net long, name string")
    assert tuple(scores.net_scores(cells, truth, names, called).first())[2:] == (4, 2, 3, 2, "C→")  # 2 (50 of 51) and 3; the tie of 1 goes to net 5
    assert scores.net_scores(cells, truth.limit(0), names, called).count() == 0
    assert tuple(scores.net_scores(cells.limit(0), truth, names, called).first())[2:] == (4, 0, 3, 0, "gnd→,A→,C→")


def test_pins_of_a_netlist(spark):
    rows = [("a", 1, "X"), ("b", 1, "X"), ("c", 2, "Y"), ("d", None, "Y"), ("e", 3, "Net7"), ("f", 3, "Net7"), ("g", 3, None), ("h", 4, "Z"), ("i", None, "W"), ("j", None, "W")]
    pins = spark.createDataFrame([(1, 0, *r) for r in rows] + [(1, 1, "k", None, "X")], f"{KEY}, pin string, net long, gt string")
    names = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 2, "Y"), (1, 0, 3, "Q")], f"{KEY}, net long, name string")
    got = {r["page"]: tuple(r)[2:] for r in scores.pin_scores(pins, names).select(*[c if c in ("doc", "page", "pins", "located", "gt_nets", "named_nets") else F.round(c, 6).alias(c) for c in scores.pin_scores(pins, names).columns]).collect()}
    # pairs X and Net7 of X, Y, Net7, W; X and Net7 whole; X and Y named of X, Y, W
    assert got[0] == (9, 6, 1.0, 0.5, 4, 0.5, 0.666667, 3)
    assert got[1] == (1, 0, 1.0, 1.0, 0, 0.0, None, 0)
    assert scores.pin_scores(pins.limit(0), names).count() == 0
