"""Pins of a netlist on wires."""

import pytest

from tracewright.operators import pins

KEY = "doc long, page long"
PIN = f"{KEY}, pin_id long, name string, x0 double, y0 double, x1 double, y1 double"
LINE = f"{KEY}, seg_id long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(scope="module")
def heights(spark):
    return spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0)], f"{KEY}, s double")


def test_pins_meet_ends_then_passing_wires_then_stand_in(spark, heights):
    p = spark.createDataFrame([
        (1, 0, 1, "U1-1", 0.0, 0.0, 4.0, 2.0),  # two ends: the one nearer to the centre
        (1, 0, 2, "U1-2", 100.0, 0.0, 104.0, 2.0),  # a wire passes through
        (1, 0, 3, "U1-3", 200.0, 0.0, 204.0, 2.0),  # a wire only touches the grown box: no segment, no stand-in
        (1, 0, 4, "U1-4", 300.0, 0.0, 304.0, 2.0),  # nothing: stands in, level
        (1, 0, 5, "U1-5", 400.0, 0.0, 401.0, 6.0),  # nothing: stands in, upright
        (1, 0, 6, "X", 500.0, 0.0, 504.0, 2.0),  # nothing, not in the netlist
        (1, 0, 7, "U1-7", None, 0.0, 4.0, 2.0),
        (2, 0, 8, "U1-4", 0.0, 0.0, 4.0, 2.0),  # a page without wires
    ], PIN)
    segs = spark.createDataFrame([(1, 0, 10, 4.0, 2.0, 50.0, 2.0), (1, 0, 11, 2.0, 1.5, 2.0, 60.0), (1, 0, 12, 90.0, 1.0, 120.0, 1.0), (1, 0, 13, 190.0, 3.2, 220.0, 3.2)], LINE)
    net = spark.createDataFrame([(1, 0, f"U1-{i}", n) for i, n in ((1, "A"), (2, "B"), (3, "A"), (4, "A"), (5, "Net7"), (7, "A"))] + [(1, 0, "U1-4", "A"), (2, 0, "U1-4", "A")], f"{KEY}, name string, net string")
    located, stand = pins.pin_segments(p, segs, net, heights)
    assert {(r["doc"], r["pin_id"], r["seg_id"], r["own"]) for r in located.collect()} == {(1, 1, 11, False), (1, 2, 12, False), (1, 4, 14, True), (1, 5, 15, True), (2, 8, 0, True)}
    assert {tuple(r)[2:] for r in stand.where("doc = 1").collect()} == {(14, 300.0, 1.0, 304.0, 1.0), (15, 400.5, 0.0, 400.5, 6.0)}
    edges, names = pins.netlist_edges(located, p, net)
    assert {tuple(r) for r in edges.collect()} == {(1, 0, 11, 14)}
    assert {tuple(r) for r in names.collect()} == {(1, 0, 11, "A"), (1, 0, 12, "B"), (1, 0, 14, "A"), (2, 0, 0, "A")}


def test_no_pins(spark, heights):
    p, s, n = spark.createDataFrame([], PIN), spark.createDataFrame([], LINE), spark.createDataFrame([], f"{KEY}, name string, net string")
    located, stand = pins.pin_segments(p, s, n, heights)
    assert located.count() == stand.count() == 0
    assert all(t.count() == 0 for t in pins.netlist_edges(located, p, n))
