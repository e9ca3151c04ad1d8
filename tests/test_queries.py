"""Queries against DuckDB on the smallest tables, and the rules against worked examples."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import text_rules as R
from tracewright.jobs import catalog
from tracewright.operators import graph, nets, spatial

SF = "/root/testdata/sf0.001"
#: Cheap ones that between them touch every operator module; the driver compares the rest.
CHECKED = ["classify_text", "classify_tokens", "csv_cell", "link_props", "marker_words", "natural_sort_key", "join_endpoints", "join_tee", "join_overlap", "join_dot_wires", "label_along_wire", "connected_components", "net_entries", "seg_at", "text_at", "comp_entries", "bom_reconcile", "match_wires", "group_precision_recall", "pin_scores", "score_average", "sentence_runs", "heading_pairs", "text_height", "twin_text_dedupe", "dot_dedupe", "pin_dedupe", "src_kicad_legacy", "src_kicad_sexpr", "src_eagle_xml", "gt_connect", "fit_transform", "attach_labels", "pen_of_text", "glue_symbols", "part_symbols", "cut_at_triangles", "prune_islands", "decode_path", "route_prims", "ground_bars", "value_extra", "wire_style", "merge_same_name", "net_name_pick", "score_compare", "port_outlines", "port_strokes", "rect_from_lines", "rect_lines_used", "rect_from_wires", "pen_roles", "pen_kinds", "pen_labels", "sentence_pairs", "sentence_pen_restore", "part_link_rows", "part_link_kinds", "components_with_links", "ground_wires", "style_wire_stats", "parts_csv_files", "report_json", "style_figures", "lettering_strays", "wiring_styles", "net_exact_naming", "pin_netlist_scores"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return con


def rows_of(cols, rows):
    tidy = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, float) else v
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in at], sorted([tuple(tidy(r[i]) for i in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalog.ORACLES[name])
    assert got == rows_of([d[0] for d in r.description], r.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_an_oracle():
    # the assignments are held against brute force below and in test_part_values.py
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"value_assign", "value_home_fallback", "part_values", "parts_with_values"}


@pytest.mark.parametrize(("text", "kind"), [("", "note"), ("12", "pin"), ("A4", "pin"), ("PWR_FLAG", "note"), ("+3.3V", "net"), ("100nF", "value"), ("two words", "note"), ("V=1", "note"), ("Q12MHz/20pF/10ppm", "value"), ("USB-UART1", "net"), ("*X", "component"), ("R12", "component"), ("WCN_1", "component"), ("LM1117-ADJ", "value"), ("1N5819S4(SOD-123)", "value"), ("x", "pin"), ("--", "note"), ("SIG_A", "net"), ("foo-bar", "net"), ("spi.clk", "net"), ("reset-n", "net"), ("LM358-N", "value"), (None, "note"), (" R1 ", "component")])
def test_kinds(spark, text, kind):
    df = spark.createDataFrame([(text,)], "s string").select(R.classify_text(F.col("s")).alias("k"))
    assert df.first()["k"] == kind


def test_distances(spark):
    r = spark.range(1).select(G.dist_point_seg(F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(9.0), F.lit(0.0)).alias("a"), G.dist_point_seg(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert (r["a"], r["b"]) == (5.0, 1.0)


def test_practice_sheet(spark):
    """A dotless crossing stays apart, a dotted tee joins, equal names join, the two sides of a part stay apart."""
    wires = [(60, 300, 380, 300), (150, 370, 200, 370), (200, 370, 200, 230), (200, 170, 240, 170), (320, 300, 320, 250), (320, 190, 360, 190), (60, 120, 140, 120), (200, 120, 300, 120), (420, 300, 500, 300), (500, 240, 540, 240)]
    segs = spark.createDataFrame([(0, 0, i, *map(float, w)) for i, w in enumerate(wires)], "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    dots = spark.createDataFrame([(0, 0, 320.0, 300.0, 2.6)], "doc long, page long, x double, y double, r double")
    labels = [("SIG_A", 62, 299), ("SIG_B", 152, 369), ("IN_L", 62, 119), ("OUT_R", 240, 119), ("EN", 422, 299), ("GND", 206, 169), ("GND", 326, 189), ("GND", 506, 239)]
    texts = spark.createDataFrame([(0, 0, i, s, "net", float(x), float(y - 5), float(x + 3 * len(s)), float(y), float(x), float(y), 5.0, 0) for i, (s, x, y) in enumerate(labels)], "doc long, page long, text_id long, str string, kind string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, size double, rot int")
    found, named = nets.extract(segs, dots, texts)
    got = {r["name"]: r["n_segs"] for r in nets.named_nets(found, named).collect()}
    assert got == {"SIG_A": 2, "SIG_B": 2, "IN_L": 1, "OUT_R": 1, "EN": 1, "GND": 3}
    entries = {r["net"]: (r["type"], r["labels"]) for r in nets.net_entries(nets.named_nets(found, named), named).collect()}
    assert entries["GND"] == ("power", 3) and entries["SIG_A"] == ("signal", 1)


def test_empty_drawing(spark):
    segs = spark.createDataFrame([], "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    dots = spark.createDataFrame([], "doc long, page long, x double, y double, r double")
    assert graph.connected_components(segs, spatial.contacts(segs, dots)).count() == 0


WIRE = "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double"
DOT = "doc long, page long, x double, y double, r double"


def test_drawings_with_the_same_page_numbers_stay_apart(spark):
    segs = spark.createDataFrame([(d, 0, i, 0.0, 0.0, 10.0, 0.0) for d in (1, 2) for i in (0, 1)], WIRE)
    dots = spark.createDataFrame([(1, 0, 5.0, 0.0, 1.0)], DOT)
    edges = {tuple(r) for r in spatial.contacts(segs, dots).select("doc", "page", "src", "dst").collect()}
    assert edges == {(1, 0, 0, 1), (2, 0, 0, 1)}
    one = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 0.0), (2, 0, 1, 0.0, 0.0, 10.0, 0.0)], WIRE)
    assert spatial.contacts(one, dots).count() == 0


def test_crowded_pages_are_solved_over_joins(spark):
    import random

    rng = random.Random(4)
    pairs = [(d, 0, rng.randrange(300), rng.randrange(300)) for d in (1, 2) for _ in range(260)] + [(1, 1, i, i + 1) for i in range(120)] + [(2, 1, None, 3)]
    edges = spark.createDataFrame(pairs, "doc long, page long, src long, dst long")
    segs = spark.createDataFrame([(d, p, i, 0.0, 0.0, 1.0, 0.0) for d in (1, 2) for p in (0, 1) for i in range(301)], WIRE)
    rows = lambda most: {tuple(r) for r in graph.connected_components(segs, edges, most).select("doc", "page", "seg_id", "root").collect()}
    assert rows(1) == rows(10**6) and len(rows(1)) == 1204


def test_chains_of_repeats(spark):
    from tracewright.operators import repeats

    dots = spark.createDataFrame([(0, 0, i, x, 0.0, 1.0) for i, x in enumerate([0.0, 0.4, 0.8, 1.2])] + [(0, 0, 9, None, 0.0, 1.0)], "doc long, page long, dot_id long, x double, y double, r double")
    assert sorted(r["dot_id"] for r in repeats.dot_dedupe(dots).collect()) == [0, 2, 9]
    assert repeats.dot_dedupe(dots.limit(0)).count() == 0


def test_assignment_is_the_cheapest(spark):
    from itertools import permutations

    import numpy as np

    from tracewright.operators import values

    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        m = n + int(rng.integers(0, 3))
        c = rng.integers(0, 20, (n, m)).astype(float)
        got = values.assignment(c)
        assert len(set(got)) == n
        assert c[np.arange(n), got].sum() == min(sum(c[i, p] for i, p in enumerate(ps)) for ps in permutations(range(m), n))
    # a row of four: every reference stands beside its neighbour's value
    pairs = [(0, 0, i, v, cost) for i in range(4) for v, cost in ((i, 5.0), (i - 1, 2.0)) if v >= 0]
    df = spark.createDataFrame(pairs, "doc long, page long, part long, value long, cost double")
    assert {(r["part"], r["value"]) for r in values.value_assign(df, 45.0).collect()} == {(i, i) for i in range(4)}
    assert values.value_assign(df.limit(0), 45.0).count() == 0


def test_home_fallback_takes_each_value_once(spark):
    from tracewright.operators import values

    cols = "doc long, page long, {} long, symbol long, x double, y double"
    parts = spark.createDataFrame([(0, 0, 1, 7, 0.0, 0.0), (0, 0, 2, 7, 1.0, 0.0), (0, 0, 3, 8, 0.0, 0.0)], cols.format("part"))
    vals = spark.createDataFrame([(0, 0, 10, 7, 2.0, 0.0), (0, 0, 11, 7, 9.0, 0.0), (0, 0, 12, 9, 0.0, 0.0)], cols.format("value"))
    assert {(r["part"], r["value"]) for r in values.value_home_fallback(parts, vals, 100.0).collect()} == {(1, 10), (2, 11)}


def test_readers_take_odd_files(spark):
    from tracewright.sources import truth

    files = spark.createDataFrame([(1, None), (2, ""), (3, "(kicad_sch (wire (pts (xy 1 2) (xy 3 4))"), (4, "Wire Wire Line"), (5, "<eagle ><sheet></sheet>")], "doc long, content string")
    assert [tuple(r) for r in truth.read_sexpr(files)["wires"].select("doc", "x1", "y2").collect()] == [(3, 1.0, 4.0)]
    assert all(t.count() == 0 for t in truth.read_legacy(files).values())
    assert all(t.count() == 0 for t in truth.read_eagle(files).values())


def test_manifest(spark, tmp_path):
    from tracewright.sources import truth

    (tmp_path / "m.json").write_text('{"about": "x", "entries": [{"id": "a-1", "tool": "t", "pdf": "d/x.pdf", "local": true}, {"id": "b-2", "tool": "t", "pdf": "d/y.pdf", "source": "d/y.sch", "sheet": 1}]}')
    e = truth.read_manifest(spark, str(tmp_path / "m.json"))
    got = {r["id"]: (r["pdf_path"], r["source_path"]) for r in truth.manifest_filter(e, []).collect()}
    assert got == {"a-1": ("d/x.pdf", None), "b-2": ("corpus/files/b-2.pdf", "corpus/files/b-2.sch")}
    assert [r["id"] for r in truth.manifest_filter(e, ["b"], spark.createDataFrame([("corpus/files/b-2.pdf",)], "path string")).collect()] == ["b-2"]


def test_names_of_nets(spark):
    labels = spark.createDataFrame([(0, 0, 1, "ZZ", 5, 0, True, False), (0, 0, 2, "AA", 5, 0, False, False), (0, 0, 3, "+5V", 6, 1, False, False), (0, 0, 4, "B", 6, 1, False, True), (0, 0, 5, "C", 7, 2, True, True)], "doc long, page long, text_id long, str string, seg_id long, net_id long, port boolean, in_body boolean")
    assert {r["net_id"]: r["name"] for r in nets.net_name_pick(labels).collect()} == {0: "ZZ", 1: "+5V"}
    names = spark.createDataFrame([(0, 0, 1, "a", True, False), (0, 0, 2, "A", True, False), (0, 0, 3, "a", False, False), (0, 0, 4, "GND", False, False), (0, 0, 5, "gnd", False, False), (0, 0, 6, "gnd", True, True)], "doc long, page long, seg_id long, str string, port boolean, in_body boolean")
    assert {(r["src"], r["dst"]) for r in graph.same_name_edges(names).collect()} == {(1, 2), (4, 5)}


def test_long_numbers_sort_by_value(spark):
    df = spark.createDataFrame([("R2",), ("R10",), ("R0009",), ("R12345678901234567890",), ("R9234567890123456789",)], "s string")
    assert [r["s"] for r in df.orderBy(R.natural_key(F.col("s"))).collect()] == ["R2", "R0009", "R10", "R9234567890123456789", "R12345678901234567890"]
