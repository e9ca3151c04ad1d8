"""Steps whose cost grew faster than their input, or that did the same work several times."""

import pytest
from pyspark.sql import functions as F

from tracewright.jobs import evaluation_jobs as E
from tracewright.jobs import pen_jobs
from tracewright.jobs import truth_jobs as J
from tracewright.operators import outlines as B
from tracewright.operators import pens
from tracewright.operators import primitives as P
from tracewright.operators import values as V
from tracewright.sources import truth as T
from tracewright.sources.fixtures import table, tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_home_fallback_walks_sorted_pairs(spark):
    """no task for each symbol; the same choice as a plain walk."""
    part = [(d, 0, s, i, float(i * 7 % 11), float(i * 5 % 13)) for d in range(2) for i, s in enumerate([1, 2, 1, 1, 2, 3, 1, 2, 4])]
    value = [(d, 0, s, i, float(i * 3 % 7), float(i * 2 % 9)) for d in range(2) for i, s in enumerate([1, 1, 2, 2, 1, 3, 5])]
    cols = "doc long, page long, symbol long, {} long, x double, y double"
    got = V.value_home_fallback(spark.createDataFrame(part, cols.format("part")), spark.createDataFrame(value, cols.format("value")), 9.0)
    want, given = set(), set()
    for d, _, s, i, x, y in sorted(part):
        near = sorted((((x - vx) ** 2 + (y - vy) ** 2) ** 0.5, v) for vd, _, vs, v, vx, vy in value if (vd, vs) == (d, s))
        hit = next((v for r, v in near if r < 9 and (d, v) not in given), None)
        if hit is not None:
            given.add((d, hit))
            want.add((d, 0, i, hit))
    assert {tuple(r) for r in got.select("doc", "page", "part", "value").collect()} == want
    assert "FlatMapGroupsInPandas" not in _plan(got)


def test_strokes_are_decoded_once(spark):
    """one decoding, no join of the pieces with their outlines."""
    plan = _plan(J.raw_orth_segs(spark, SF))
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


@pytest.mark.parametrize(("data", "want"), [
    ([0, 1, 1, 1, 5, 1, 4], [([(1, 1), (5, 1), (1, 1)], [True, True], True)]),
    ([1, 9, 9, 0, 1, 1, 7, 1, 5, 1, 1, 6], [([(1, 1), (5, 1)], [True], False)]),
    ([0, 0, 0, 2, 1, 1, 2, 2, 3, 3, 0, 8, 8, 3, 1, 1, 9, 9], [([(0, 0), (3, 3)], [False], False), ([(8, 8), (9, 9)], [False], False)]),
    ([0, 0, 0, 1, 2, 0, 1, 2, 2, 1, 0, 0, 4, 4], [([(0, 0), (2, 0), (2, 2), (0, 0)], [True] * 3, True)]),
    ([4, 0, 3, 3, None, 1, 4, 3], [([(3, 3), (4, 3)], [True], False)]),
    ([], []),
])
def test_odd_streams(spark, data, want):
    """whole batches are decoded at once; nulls are passed over as unknown codes."""
    paths = spark.createDataFrame([(0, 0, i, None if d is None else [None if v is None else float(v) for v in d], m, 0.0) for i, (d, m) in enumerate([(None, [1.0, 0.0, 0.0, -1.0, 0.0, 0.0]), (data, [1.0, 0.0, 0.0, -1.0, 0.0, 0.0]), (data, [1.0])])], "doc long, page long, path_id long, data array<double>, ctm array<double>, height double")
    got = sorted(P.decode_path(paths).collect(), key=lambda r: r["sub"])
    assert [(r["path_id"], r["sub"], [(p["x"], p["y"]) for p in r["pts"]], r["straight"], r["closed"]) for r in got] == [(1, k, *w) for k, w in enumerate(want)]
    assert not hasattr(P, "_walk")


def test_sources_are_read_once(spark):
    """the four tables of a source come from one parse that is written."""
    files = spark.createDataFrame([(1, '(kicad_sch (label "a \\"b\\"" (at 1 2 0)) (junction (at 3 4)))'), (2, None)], "doc long, content string")
    got = T.read_sexpr(files)
    assert [tuple(r) for r in got["labels"].select("doc", "name", "x", "y").collect()] == [(1, 'a "b"', 1.0, 2.0)]
    assert not any("MapInPandas" in _plan(t) for t in got.values())
    text = "EESchema\r\nWire Wire Line\r\n\t1 2 3 4\r\nText Label 5 6 0 50 ~ 0\r\n NAME \r\nConnection ~ 7 8\r\n$Comp\r\nL Device:R R1\r\nP 1 1\r\nF 0 \"R1\" V\r\nF 1 \"10k\" V\r\n$EndComp\r\nWire Wire Line"
    got = T.read_legacy(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc long, content string"))
    assert [tuple(r) for r in got["wires"].collect()] == [(1, 1, 1.0, 2.0, 3.0, 4.0)]
    assert [tuple(r) for r in got["labels"].collect()] == [(1, 3, "NAME", 5.0, 6.0)] and [r["x"] for r in got["junctions"].collect()] == [7.0]
    assert [(r["ref"], r["value"]) for r in got["parts"].collect()] == [("R1", "10k")]
    assert "Join" not in _plan(got["wires"])


def test_true_nets_read_dealt_wires(spark):
    """wires are made once for all joins of the true nets."""
    plan = _plan(J.gt_connect(spark, SF))
    assert "InMemoryTableScan" in plan and "lineitem" not in "".join(line for line in plan.splitlines() if line.startswith("+- Exchange"))


def test_what_tables_are_made_of_is_kept(spark):
    """Several tables of one drawing share their base."""
    spark.catalog.clearCache()
    t, s = tables(spark, SF, "texts", "segs")
    assert s.storageLevel.useMemory and "InMemoryTableScan" in _plan(t)
    assert t.count() == s.where(F.col("seg_id") % 5 == 0).count() == table(spark, SF, "texts").count()


def test_sentences_are_read_off_one_order(spark):
    """words are not shuffled and not joined; the kinds are those of the pairs, the notes and their undo."""
    plan = _plan(pen_jobs.sentence_pen_restore(spark, SF))
    assert "Join" not in plan and plan.count("Exchange") == 1
    kinds, colors, sizes = ["net", "value", "pin", "value", "note", None, "value"], ["#a", "#b", None, "#a", "#a", "#b"], [5.0, 6.0, None]
    rows = [(d, None if d == 2 else 0, i, kinds[(i * 5 + d) % 7], i % 6 * 10.0, None if i % 41 == 7 else i % 6 * 10.0 + (9.0, 10.0, 7.5, 11.0)[(i * 3 + d) % 4], float(i // 6), sizes[i % 3 if i % 8 == 0 else i % 2], colors[(i * 7 + i // 9) % 6]) for d in range(3) for i in range(300)]
    t = spark.createDataFrame(rows, "doc long, page long, text_id long, kind string, x0 double, x1 double, y double, size double, color string")
    got = lambda df: sorted(map(str, df.select("doc", "page", "text_id", "kind").collect()))
    pairs = pens.sentence_pairs(t, ["y"])
    assert got(pens.kinds_by_sentence(t, ["y"])) == got(pens.sentence_pen_restore(pens.with_notes(t, pairs), pairs))
    assert pairs.count() > 30 and got(t) != got(pens.kinds_by_sentence(t, ["y"]))


def test_turns_are_searched_for_once(spark):
    """one search for turns, kept for the three steps of a walk; walks are dealt out without pandas."""
    four = lambda d, n: [(d, 0, n, 0.0, 0.0, 9.0, 0.0), (d, 0, n + 1, 9.0, 0.0, 9.0, 5.0), (d, 0, n + 2, 0.0, 5.0, 9.0, 5.0), (d, 0, n + 3, 0.0, 0.0, 0.0, 5.0)]
    lines = spark.createDataFrame([*four(0, 0), *four(1, 7), (2, 0, 1, 0.0, 0.0, 9.0, 0.0), (2, 0, 2, 9.0, 0.0, 9.0, None)], "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    outlines, used = B.rect_from_lines(lines, lines.select("doc", "page").distinct().withColumn("s", F.lit(5.0)))
    assert sorted(map(tuple, outlines.collect())) == [(0, 0, 0, 0.0, 0.0, 9.0, 5.0), (1, 0, 7, 0.0, 0.0, 9.0, 5.0)] and used.count() == 8
    plan = _plan(used)
    assert "InMemoryTableScan" in plan and "FlatMapGroupsInArrow" in plan


def test_used_lines_start_no_walk(spark):
    """the choice among closed walks is that of a plain pass."""
    walks = [(d, 0, (i * 7 + d) % 23, [float(i)], [(i * 7 + d) % 23, (i * 5) % 23, (i * 11 + 1) % 23]) for d in range(3) for i in range(30)]
    want = []
    for d in range(3):
        used, mine = set(), [w for w in walks if w[0] == d]
        for line in sorted({w[2] for w in mine}):
            of = [w for w in mine if w[2] == line] if line not in used else []
            want += of
            used.update(x for w in of for x in w[4])
    got = B._first_fit(spark.createDataFrame(walks, B._STARTS)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(got) < len(walks)


def test_shared_lengths_are_made_once(spark):
    """both readers of the shared lengths read one table, which is made of strokes that are made once."""
    spark.catalog.clearCache()
    plan = _plan(E.net_exact(spark, SF))
    assert plan.count("InMemoryTableScan [doc") + plan.count("Scan In-memory") >= 2 and "InMemoryRelation" in plan
