"""Outlines, pens, links and sinks: worked examples, ties, nulls and empty tables. The queries over the given tables are compared with DuckDB in test_queries."""

import codecs
import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import outlines as B
from tracewright.operators import part_links as K
from tracewright.operators import pens as P
from tracewright.operators import primitives, scores
from tracewright.sources import sinks

KEY = "doc long, page long"
LINE = f"{KEY}, seg_id long, x1 double, y1 double, x2 double, y2 double"
BOX = "x0 double, y0 double, x1 double, y1 double"


@pytest.fixture(scope="module")
def heights(spark):
    return spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0)], f"{KEY}, s double")


def lines(spark, rows, doc=1):
    return spark.createDataFrame([(doc, 0, i, *map(float, r)) if r else (doc, 0, i, None, None, None, None) for i, r in enumerate(rows)], LINE)


def boxes(df):
    return sorted(tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in df.collect())


def square(x, y, w=20, h=10):
    return [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]


def test_bodies_of_four_lines(spark, heights):
    # two bodies share an edge, a third lacks one, a fourth has a corner a hair apart; a null line meets nothing
    rows = [*square(0, 0), *square(20, 0)[:3], *square(100, 0)[:3], (200, 0, 220, 0.01), (220.1, 0, 220.1, 10), (220, 10.1, 200, 10.1), (200, 10, 200, 0), None]
    found, used = B.rect_from_lines(lines(spark, rows), heights)
    assert boxes(found) == [(0.0, 0.0, 20.0, 10.0), (20.0, 0.0, 40.0, 10.0), (200.0, 0.0, 220.0, 10.1)]
    assert {r["seg_id"] for r in used.collect()} == {0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13}


def test_a_used_line_starts_no_further_body(spark, heights):
    # the level line in the middle closes the first body; the second starts at its own upper edge
    rows = [(0, 0, 20, 0), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0), (20, 10, 20, 20), (0, 20, 20, 20), (0, 20, 0, 10)]
    found, _ = B.rect_from_lines(lines(spark, rows), heights)
    assert sorted((r["line"], r["y0"], r["y1"]) for r in found.collect()) == [(0, 0.0, 10.0), (5, 10.0, 20.0)]


def test_hot_corner(spark, heights):
    rows = [(50, 50, 50 + 10 * k, 50) for k in range(1, 40)] + [(50, 50, 50, 50 + 10 * k) for k in range(1, 40)] + [(60, 50, 60, 60), (60, 60, 50, 60)]
    found, _ = B.rect_from_lines(lines(spark, rows), heights)
    assert boxes(found) == [(50.0, 50.0, 60.0, 60.0)]


def test_bodies_among_wires(spark, heights):
    rows = [*square(0, 0, 40, 20), *square(100, 0, 10, 10), *square(200, 0, 40, 20), *square(300, 0, 40, 20)]
    texts = spark.createDataFrame([(1, 0, 18.0, 8.0, 22.0, 12.0), (1, 0, None, None, None, None), (1, 0, 238.0, 18.0, 242.0, 22.0)], f"{KEY}, {BOX}")
    parts = spark.createDataFrame([(1, 0, 299.0, -1.0, 341.0, 21.0)], f"{KEY}, {BOX}")
    found, used = B.rect_from_wires(lines(spark, rows), texts, parts, heights)
    assert boxes(found) == [(0.0, 0.0, 40.0, 20.0), (100.0, 0.0, 110.0, 10.0), (300.0, 0.0, 340.0, 20.0)]  # text inside, small, in a link; the third only has a centre on its corner
    assert used.count() == 12


def port(x, y, tip=True):
    return [(x, y, x + 4, y - 4), (x, y, x + 4, y + 4)] if tip else [], [(x + 4, y - 4, x + 24, y - 4), (x + 4, y + 4, x + 24, y + 4), (x + 24, y - 4, x + 24, y + 4)]


def ports_of(spark, heights, diags, strokes, glyphs=()):
    d = lines(spark, diags).withColumnRenamed("seg_id", "diag_id")
    s = lines(spark, strokes).withColumn("glyph", F.col("seg_id").isin(*glyphs) if glyphs else F.lit(False))
    return B.port_outlines(d, s, heights)


def test_stacked_ports_stay_apart(spark, heights):
    d, s = zip(*[port(0, 8 * k) for k in range(4)], strict=True)
    found, claims = ports_of(spark, heights, sum(d, []), sum(s, []))
    assert boxes(found) == [(0.0, 8.0 * k - 4, 24.0, 8.0 * k + 4) for k in range(4)]
    assert claims.count() == 12
    # the leads of two ports and a back edge between them are no port: nothing closes the far ends
    open_ = [x[:2] for x in s]
    found, claims = ports_of(spark, heights, sum(d, []), sum(open_, []))
    assert found.count() == 0 and claims.count() == 0


def test_ways_to_close_a_port(spark, heights):
    d, s = port(0, 0)
    assert boxes(ports_of(spark, heights, [*d, (24, -4, 28, 0), (28, 0, 24, 4)], s[:2])[0]) == [(0.0, -4.0, 24.0, 4.0)]  # a second tip; the box is that of the first
    assert ports_of(spark, heights, d, [*s[:2], (24, -4, 24, 3)])[0].count() == 0  # 7 of 8
    assert ports_of(spark, heights, d, [*s[:2], (24, -4, 24, 3), (24, 3, 24, 4)], glyphs=[3])[0].count() == 1
    assert ports_of(spark, heights, d, [s[0], (4, 4, 20, 4), s[2]])[0].count() == 0  # edges of different length
    assert ports_of(spark, heights, [(0, 0, 4, -4), (0.5, 0, 4, 4)], s)[0].count() == 0  # the strokes do not meet
    double = ports_of(spark, heights, [*d, *d], [*s, *s])
    assert double[0].count() == 1 and double[1].count() == 6  # drawn twice: one outline, all strokes claimed


def test_symbols_in_ports_go(spark, heights):
    found, _ = ports_of(spark, heights, *port(0, 0))
    sym = spark.createDataFrame([(1, 0, 1, 0.0, -4.2, 4.0, 4.0), (1, 0, 2, -1.0, -4.0, 4.0, 4.0), (2, 0, 3, 0.0, -4.0, 4.0, 4.0)], f"{KEY}, sym_id long, {BOX}")
    assert {r["sym_id"] for r in B.symbols_outside(sym, found, heights).collect()} == {2, 3}


def test_outlines_of_nothing(spark, heights):
    none = lines(spark, [])
    assert all(t.count() == 0 for t in B.rect_from_lines(none, heights))
    assert all(t.count() == 0 for t in B.rect_from_lines(lines(spark, square(0, 0)), heights.limit(0)))
    assert all(t.count() == 0 for t in ports_of(spark, heights, [], []))
    assert all(t.count() == 0 for t in ports_of(spark, heights, [(None,) * 4][:0], [None]))


TEXT = f"{KEY}, text_id long, str string, kind string, {BOX}, ax double, ay double, size double, rot int, color string"


def text(i, s, kind, color, x=0.0, y=0.0, doc=1):
    return (doc, 0, i, s, kind, x, y - 5, x + 3 * len(s), y, x, y, 5.0, 0, color)


def pens_page(spark, labels=6, stray=1):
    rows = [text(i, f"SIG_{i}", "net", "blue", 2.0, 40.0 * i - 1) for i in range(labels)]
    rows += [text(100 + i, f"R{i}", "component", "red", 300.0, 40.0 * i) for i in range(6)] + [text(120 + i, "VALUE", "net", "red", 2.0, 1000.0 + 40 * i - 1) for i in range(stray)]
    rows += [text(200 + i, str(i), "pin", "green", 500.0, 40.0 * i) for i in range(9)] + [text(209, "CD1", "component", "green", 500.0, 900.0)]
    rows += [text(300 + i, "a note", "note", "grey", 700.0, 40.0 * i) for i in range(4)] + [text(304, "Power", "net", "grey", 2.0, 2000.0 - 1), text(305, "Q", "net", None, 900.0, 0.0)]
    wires = [(0.0, 40.0 * i, 60.0, 40.0 * i) for i in range(labels)] + [(0.0, 1000.0 + 40 * i, 60.0, 1000.0 + 40 * i) for i in range(stray)] + [(0.0, 2000.0, 60.0, 2000.0)]
    marks = spark.createDataFrame([], f"{KEY}, sym_id long, {BOX}")
    flags = spark.createDataFrame([], f"{KEY}, text_id long, {BOX}")
    return spark.createDataFrame(rows, TEXT), lines(spark, wires), marks, flags


def test_pens_settle_doubtful_texts(spark):
    texts, segs, marks, flags = pens_page(spark)
    settled, attached = P.settled_labels(texts, segs, marks, flags)
    roles = {r["color"]: r["role"] for r in settled.select("color", "role").distinct().collect()}
    assert roles == {"blue": "label", "red": "field", "green": "pin", "grey": "note", None: None}
    kinds = {r["text_id"]: r["kind"] for r in settled.collect()}
    assert (kinds[304], kinds[209], kinds[305], kinds[120]) == ("note", "pin", "net", "net")
    assert {r["text_id"] for r in attached.collect()} == set(range(6))  # the field and the note on wires are labels no more


def test_pages_without_a_label_pen_keep_the_first_result(spark):
    texts, segs, marks, flags = pens_page(spark, labels=3)
    settled, attached = P.settled_labels(texts, segs, marks, flags)
    assert settled.where("role is not null or again").count() == 0 and {r["text_id"] for r in attached.collect()} == {0, 1, 2, 120, 304}
    none = P.settled_labels(texts.limit(0), segs, marks, flags)
    assert none[0].count() == 0 and none[1].count() == 0


def test_linked_texts_keep_their_kind(spark):
    texts, segs, marks, flags = pens_page(spark)
    settled, _ = P.settled_labels(texts.withColumn("linked", F.when(F.col("text_id") == 304, True)), segs, marks, flags)
    assert settled.where("text_id = 304").first()["kind"] == "net"


def test_notes_of_two_pens_are_undone(spark):
    rows = [(1, 0, i, k, 10.0 * i, 10.0 * i + 9, 5.0, 0, c) for i, (k, c) in enumerate([("net", "a"), ("component", "b"), ("net", "b"), ("value", None), ("pin", "a"), ("value", "c"), ("value", "d")])]
    t = spark.createDataFrame(rows, f"{KEY}, text_id long, kind string, x0 double, x1 double, size double, y int, color string")
    pairs = P.sentence_pairs(t, ["y"])
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 1), (1, 2), (2, 3)}  # no pin, no two values
    noted = P.with_notes(t, pairs)
    back = {r["text_id"]: r["kind"] for r in P.sentence_pen_restore(noted, pairs).collect()}
    assert back == {0: "net", 1: "note", 2: "note", 3: "note", 4: "pin", 5: "value", 6: "value"}  # 0 and 1 differ; 1 and 2, 2 and 3 stay
    assert P.sentence_pen_restore(noted.limit(0), pairs).count() == 0


LINK = f"{KEY}, link_id long, {BOX}, text string, ref_prop string, value_prop string"


def test_part_links(spark, heights):
    texts = spark.createDataFrame([(1, 0, 1, "R1", "component", 1.0, 1.0, 6.0, 5.0, 5.0), (1, 0, 2, "10k", "value", 1.0, 6.0, 9.0, 9.0, 5.0), (1, 0, 3, "U7", "component", 41.0, 1.0, 49.0, 5.0, 5.0), (1, 0, 4, "CLK", "net", 42.0, 20.0, 50.0, 24.0, 5.0), (1, 0, 5, None, "net", 43.0, 20.0, 50.0, 24.0, 5.0)], f"{KEY}, text_id long, str string, kind string, {BOX}, size double")
    rows = [(1, 0, 1, 0.0, 0.0, 20.0, 20.0, "R1\r\n10k \n", None, None), (1, 0, 2, 40.0, 0.0, 80.0, 40.0, "U7\nCLK\nD0\nD1\nD2", None, None), (1, 0, 3, 200.0, 0.0, 220.0, 20.0, "C9\n1u", None, None), (1, 0, 4, 300.0, 0.0, 320.0, 20.0, None, "C5", "100n"), (1, 0, 5, 400.0, 0.0, 420.0, 20.0, " \n", None, None), (1, 0, 6, 45.0, 18.0, 52.0, 26.0, "x", "U7", ""), (3, 0, 7, 0.0, 0.0, 1.0, 1.0, "R1", "R1", None)]
    links = spark.createDataFrame(rows, LINK)
    got = K.part_link_rows(links, texts, heights)
    assert sorted((r["link_id"], r["ref"], r["values"], r["has_text"]) for r in got.collect()) == [(1, "R1", ["10k"], True), (2, "U7", [], True), (4, "C5", ["100n"], False), (6, "U7", [], False)]
    nets = spark.createDataFrame([], f"{KEY}, link_id long, {BOX}, chained boolean")
    pages, parts, labels = K.trusted(got, nets, texts)
    assert [tuple(r) for r in pages.collect()] == [(1, 0, 0)]
    kinds = {r["text_id"]: (r["kind"], r["in_body"]) for r in K.rekind_by_links(texts, pages, parts, labels).collect()}
    assert kinds == {1: ("component", False), 2: ("value", False), 3: ("component", False), 4: ("pin", True), 5: ("pin", True)}
    read = spark.createDataFrame([(1, 0, "R1", ["9k"]), (1, 0, "U7", ["x"])], f"{KEY}, ref string, values array<string>")
    assert {r["ref"]: (r["values"], r["from_link"]) for r in K.components_with_links(read, parts).collect()} == {"R1": (["10k"], False), "U7": (["x"], False), "C5": (["100n"], True)}
    few = K.trusted(got.where("link_id < 4"), nets, texts)
    assert all(t.count() == 0 for t in few)
    same = K.rekind_by_links(texts, *few)
    assert {r["text_id"]: r["kind"] for r in same.collect()} == {r["text_id"]: r["kind"] for r in texts.collect()}


def test_linked_labels_make_other_nets_notes(spark):
    t = [(1, 0, i, f"N{i}", "net", 10.0 * i, 0.0, 10.0 * i + 8, 5.0, 5.0) for i in range(5)]
    texts = spark.createDataFrame(t, f"{KEY}, text_id long, str string, kind string, {BOX}, size double")
    nets = spark.createDataFrame([(1, 0, i, 10.0 * i, 0.0, 10.0 * i + 8, 5.0, False) for i in range(3)], f"{KEY}, link_id long, {BOX}, chained boolean")
    parts = spark.createDataFrame([], f"{KEY}, link_id long, {BOX}, ref string, values array<string>, has_text boolean")
    pages, parts, labels = K.trusted(parts, nets, texts)
    assert {r["text_id"]: (r["kind"], r["linked"]) for r in K.rekind_by_links(texts, pages, parts, labels).collect()} == {0: ("net", True), 1: ("net", True), 2: ("net", True), 3: ("note", False), 4: ("note", False)}


def test_a_failed_run_of_bars_starts_again(spark):
    bars = lambda page, lens, step=2.0: [(1, page, True, 10.0, 5 + step * k, float(v)) for k, v in enumerate(lens)]
    rows = [*bars(0, [5, 9, 8, 7]), *bars(1, [9, 8, 7, 7]), *bars(2, [4, 5, 6, 5, 4, 3]), *bars(3, [3, 4]), *bars(4, [9, 8, 7], 5.0), (1, 5, True, None, 1.0, 2.0), *bars(6, [9, 8, 7]), *bars(7, [9, 9.02, 9.04])]
    df = spark.createDataFrame(rows, f"{KEY}, level boolean, centre double, pos double, len double")
    got = {r["page"]: (r["first"], r["n"], r["shrinks"], r["top"]) for r in primitives.ground_bars(df, 5.0).collect()}
    assert got == {0: (7.0, 3, True, 7.0), 2: (9.0, 4, True, 9.0), 6: (5.0, 3, True, 5.0)}
    wires = spark.createDataFrame([(1, 6, 1, 10.0, 4.0, 10.0, -20.0), (1, 6, 2, 10.0, 3.0, 40.0, 3.0), (1, 0, 3, 10.0, 14.0, 10.0, 40.0)], LINE)
    assert [(r["page"], r["seg_id"]) for r in primitives.ground_wires(primitives.ground_bars(df, 5.0), wires, 5.0).collect()] == [(6, 1)]
    assert primitives.ground_bars(df.limit(0), 5.0).count() == 0


def test_styles_on_true_wires(spark):
    s = [(1, 0, i, 10.0 * i, 0.0, 10.0 * i + 10, 0.0, "a", None) for i in range(4)] + [(1, 0, 9, 0.0, 5.0, 10.0, 5.0, "b", True), (1, 0, 10, 3.0, 3.0, 3.0, 3.0, "c", False), (2, 0, 11, 0.0, 0.0, 10.0, 0.0, "a", False)]
    segs = spark.createDataFrame(s, f"{LINE}, style string, closed boolean")
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (2, 0, 0.0, 0.0, 5.0, 0.0)], f"{KEY}, x1 double, y1 double, x2 double, y2 double")
    fits = spark.createDataFrame([(1, 0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.5)], f"{KEY}, a double, b double, c double, d double, e double, f double")
    got = [tuple(r)[2:] for r in scores.style_wire_stats(segs, truth, fits).orderBy("rank").collect()]
    assert got == [(1, "a", 4, 10.0, 0.0, 0.5), (2, "b", 1, 10.0, 1.0, 0.0), (3, "c", 1, 0.0, 0.0, None)]
    assert scores.style_wire_stats(segs, truth, fits.limit(0)).count() == 0


def test_csv_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "+5V", 3, "1 2"), (1, 1, 'a"b', None, ""), (1, 3, "x,y\n", 1, None), (3, 1, "gone", 1, "1")], "doc long, place int, net string, labels long, pages string")
    path = str(tmp_path / "csv")
    sinks.write_csv(rows, ["net", "labels", "pages"], ["net", "labels", "pages"], spark.createDataFrame([(1,), (2,), (2,)], "doc long"), path)
    files = {r["doc"]: bytes(r["content"]) for r in sinks.written_files(spark, path).collect()}
    head = codecs.BOM_UTF8 + b"net,labels,pages\r\n"
    assert files == {1: head + b'"a""b",,\r\n"=""+5V""",3,1 2\r\n"x,y\n",1,\r\n', 2: head}
    assert (tmp_path / "csv" / "_SUCCESS").exists()


def test_reports(spark, tmp_path):
    nets = spark.createDataFrame([(1, 2, "B", "signal", 1, "2 10"), (1, 1, "GND", "power", 4, "1")], "doc long, place int, net string, type string, labels long, pages string")
    parts = spark.createDataFrame([(1, 1, "R1", ["1k", "5 %"], "1")], "doc long, place int, ref string, values array<string>, pages string")
    path = str(tmp_path / "reports")
    sinks.write_reports(sinks.reports(spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "doc long, file string"), nets, parts), path, files=2)
    got = sorted((json.loads(r["value"]) for r in spark.read.text(path).collect()), key=lambda r: r["file"])
    assert got[0] == {"file": "a.pdf", "nets": [{"name": "GND", "power": True, "labelCount": 4, "pages": [1]}, {"name": "B", "power": False, "labelCount": 1, "pages": [2, 10]}], "components": [{"ref": "R1", "values": ["1k", "5 %"], "pages": [1]}]}
    assert got[1] == {"file": "b.pdf", "nets": [], "components": []}


def test_a_label_takes_the_wire_it_stands_in_line_with(spark):
    from tracewright.operators import labels as L

    # two supply arrows that touch are one symbol with two wires below; the names stand above their own
    sym = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 20.0, 6.0)], f"{KEY}, sym_id long, {BOX}")
    segs = lines(spark, [(4, 6, 4, 40), (16, 6, 16, 40), (8, 4, 12, 4)])
    rows = [(1, 0, 1, "VCC", "net", 0.0, -6.0, 8.0, -1.0, 0.0, -1.0, 5.0, 0, None), (1, 0, 2, "VDD", "net", 12.0, -6.0, 20.0, -1.0, 12.0, -1.0, 5.0, 0, None)]
    texts = spark.createDataFrame(rows, TEXT)
    flags = spark.createDataFrame([], f"{KEY}, text_id long, {BOX}")
    found = lambda mono: {r["text_id"]: r["seg_id"] for r in L.attach_labels(texts, segs, sym, flags, monochrome=mono).where("via = 'symbol'").collect()}
    assert found(False) == {1: 0, 2: 1} and found(True) == {1: 0, 2: 0}


def test_stacked_ports_name_the_label_in_line(spark):
    from tracewright.operators import labels as L

    sym = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 20.0, 8.0), (1, 0, 2, 0.0, 8.0, 20.0, 16.0)], f"{KEY}, sym_id long, {BOX}")
    texts = spark.createDataFrame([(1, 0, 1, "SIG", "net", 21.0, 9.5, 30.0, 14.5, 21.0, 14.5, 5.0, 0, None)], TEXT)
    near = lambda s: [r["sym_id"] for r in L.symbol_candidates(texts, s).orderBy("r").collect()]
    assert near(sym.withColumn("port", F.lit(True))) == [2]


def test_intermediate_tables_can_be_removed(spark):
    from tracewright.sources import shared

    t = shared.written(spark.range(3).toDF("id"), "probe")
    assert t.count() == 3 and shared.remove_intermediate(spark) > 0 and shared.remove_intermediate(spark) == 0


def test_outlines_of_parts_and_flags(spark):
    from tracewright.operators import bodies as D

    pages = spark.createDataFrame([(1, 0, 5.0, 20000.0)], f"{KEY}, s double, area double")
    outlines = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 40.0, 40.0), (1, 0, 2, 0.0, 0.0, 20.0, 20.0), (1, 0, 3, 0.0, 0.0, 100.0, 100.0), (1, 0, 4, 60.0, 60.0, 90.0, 90.0), (1, 0, 5, 8.0, 8.0, 16.0, 15.0), (1, 0, 6, None, 0.0, 1.0, 1.0), (2, 0, 7, 0.0, 0.0, 40.0, 40.0)], f"{KEY}, body long, {BOX}")
    rows = [(1, 0, 1, "net", 9.0, 9.0, 15.0, 14.0, 5.0), (1, 0, 2, "net", 30.0, 30.0, 36.0, 35.0, 5.0), (1, 0, 3, "net", 70.0, 70.0, 76.0, 75.0, 5.0), (1, 0, 4, "net", 94.0, 94.0, 98.0, 98.0, 5.0), (1, 0, 5, "net", 17.0, 0.0, 23.0, 5.0, 5.0), (1, 0, 6, "net", None, 0.0, 1.0, 1.0, 5.0)]
    texts = spark.createDataFrame(rows, f"{KEY}, text_id long, kind string, {BOX}, size double")
    segs = lines(spark, [(62, 62, 80, 62), (62, 64, 80, 64), (1, 30, 39, 30)])
    found = {r["text_id"]: r["body"] for r in D.text_in_body(texts, outlines, segs, pages).collect()}
    assert found == {1: 2, 2: 1, 5: 1}  # two wires inside the fourth; the third is over a quarter of the page; a centre on an edge is not inside
    assert {r["text_id"]: r["body"] for r in D.flag_of_label(texts, outlines, pages).collect()} == {1: 5}
    two = texts.unionByName(texts.where("text_id = 1").withColumn("text_id", F.lit(9).cast("long")))
    assert D.flag_of_label(two, outlines, pages).count() == 0
    assert D.flag_of_label(texts.withColumn("kind", F.lit("pin")), outlines, pages).count() == 0
    assert D.text_in_body(texts, outlines.limit(0), segs, pages).count() == 0
