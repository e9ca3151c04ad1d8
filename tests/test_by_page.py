"""Tables are dealt by page once; cells are shuffled only where a page is crowded."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.jobs import evaluation_jobs, net_jobs, pin_jobs, summary_jobs
from tracewright.operators import graph, nets, spatial
from tracewright.sources import fixtures
from tracewright.sources.fixtures import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k in keys:
        spark.conf.unset(k)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contacts_shuffle_no_cells(spark, no_broadcast):
    segs, dots = table(spark, SF, "segs"), table(spark, SF, "dots")
    dealt = [line for line in _plan(spatial.contacts(segs, dots)).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("gx#" in line or "seg_id#" in line for line in dealt)


def test_contacts_join_ends_with_segments_once(spark, no_broadcast):
    segs, dots = table(spark, SF, "segs"), table(spark, SF, "dots")
    on_cells = [line for line in _plan(spatial.contacts(segs, dots)).splitlines() if "SortMergeJoin" in line and "gx#" in line]
    assert len(on_cells) == 3  # ends at dots, ends on segments, dots on segments


def test_crowded_pages_give_the_same_nets(spark, no_broadcast):
    drawing = [table(spark, SF, n) for n in ("segs", "dots", "texts")]
    rows = lambda df: sorted(map(tuple, df.select("doc", "page", "seg_id", "net_id").collect()))
    whole, spread = nets.extract(*drawing), nets.extract(*drawing, most=10)
    assert rows(whole[0]) == rows(spread[0]) and rows(whole[1]) == rows(spread[1])
    assert "gx#" in "".join(line for line in _plan(spatial.contacts(*drawing[:2], spread=True)).splitlines() if "Exchange" in line)


def test_ends_without_a_coordinate_link_as_before(spark):
    segs = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, None, 0.0), (0, 0, 1, -5.0, 0.0, 5.0, 0.0), (0, 0, 2, 3.0, 0.0, 3.0, 9.0)], "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    dots = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 0, 3.0, 0.0, 1.0)], "doc long, page long, x double, y double, r double")
    roots = {r.seg_id: r.root for r in graph.connected_components(segs, spatial.contacts(segs, dots)).collect()}
    assert roots == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("query", [net_jobs.page_stats, net_jobs.net_info, net_jobs.union_box, net_jobs.focus_texts, net_jobs.label_occurrences, net_jobs.assign_nets, summary_jobs.page_summary, summary_jobs.net_selection, evaluation_jobs.score_compare, pin_jobs.nets_with_stand_ins])
def test_strokes_stay_kept_for_all_readers(spark, query):
    """No table of a drawing is made after the strokes are kept, which would drop them."""
    spark.catalog.clearCache()
    query(spark, SF)
    assert table(spark, SF, "segs").storageLevel.useMemory
    spark.catalog.clearCache()


def test_nets_are_numbered_in_one_pass(spark, no_broadcast):
    """F2 and all readers of the netlist: components are read once, without a join with their roots."""
    c = spark.createDataFrame([(d, 0, i, [7, 3, 3, 12, 7, 5][i] + d) for d in range(2) for i in range(6)], "doc long, page long, seg_id long, root long")
    rows = lambda df: sorted(map(tuple, df.select("doc", "page", "seg_id", "root", "net_id").collect()))
    assert rows(nets.number_nets(c)) == rows(nets.number_nets(c, spread=True)) and [r[4] for r in rows(nets.number_nets(c))[:6]] == [2, 0, 0, 3, 2, 1]
    assert "Join" not in _plan(nets.number_nets(c))


@pytest.mark.parametrize("query", [evaluation_jobs.score_compare, evaluation_jobs.wire_precision_recall])
def test_lines_are_shuffled_once(spark, no_broadcast, query):
    """F5, F13 and all readers of strokes: lines are dealt by page as they are read; merging equal ones and numbering them stay in place."""
    spark.catalog.clearCache()
    assert _plan(table(spark, SF, "segs")).count("Exchange") == 1
    dealt = [line for line in _plan(query(spark, SF)).splitlines() if "Exchange " in line]
    assert dealt and not any("l_linenumber#" in line or "sheet#" in line for line in dealt)
    spark.catalog.clearCache()


def test_dealt_strokes_are_those_of_the_sql(spark):
    """the same rows and types for given lines and for odd ones: equal lines, nulls, negative and very large keys."""
    odd = [(k, p, s, n, q, f, "O") for k in (None, -1, -751, 0, 149, 150, 10**16 + 7) for p, s, n, q, f in [(1, 2, 1, 3.7, "A"), (1, 2, 1, -8.0, "N"), (1, 2, 2, None, "R"), (None, 2, 1, 5.0, "R"), (4, None, 1, 5.0, None), (4, 4, None, 41.0, "N"), (3, 7, 2, 12.0, "A")]]
    lines = spark.createDataFrame(odd, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    for given in (lines, spark.read.parquet(f"{SF}/lineitem.parquet")):
        got, want = fixtures.dealt_segs(given), spark.sql(fixtures.SQL["segs"], lineitem=given)
        assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sample_points_are_not_sorted(spark, no_broadcast):
    """wires meet segments; their points are neither joined nor dealt, whatever the session broadcasts."""
    plan = _plan(evaluation_jobs.wire_precision_recall(spark, SF)).splitlines()
    assert any("bit_or" in line for line in plan) and not any(("Join" in line or "Sort " in line) and " k#" in line for line in plan)
    spark.catalog.clearCache()


def test_strokes_without_length_are_scored(spark, tmp_path):
    """a stroke of no length ended the query with a division by zero."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_quantity", F.when(F.col("l_partkey") % 3 == 0, -1.0).otherwise(F.col("l_quantity"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = evaluation_jobs.wire_precision_recall(spark, str(tmp_path)).collect()
    assert len(got) == table(spark, SF, "segs").select("doc", "page").distinct().count() and all(0 < r["wire_recall"] <= 1 for r in got)
    spark.catalog.clearCache()


def test_covered_points_equal_brute_force(spark):
    """slanted, crossing, equal and short segments, one without length; wires of more than 64 points; coordinates that are missing."""
    cells = lambda a, b: range(math.floor((min(a, b) - 0.8) / 20), math.floor((max(a, b) + 0.8) / 20) + 1)
    wires = [(p, i, i * 3.0, 5.0 * i % 17, i * 3.0 + (i * 37 % 11 - 5) * (40.0 if i == 3 else 4.0), 5.0 * i % 17 + (i * 29 % 7 - 3) * 6.0) for p in (0, 1) for i in range(25)] + [(0, 90, 1.0, 1.0, None, 1.0)]
    segs = [(p, i, i * 2.5, 7.0 * i % 19, i * 2.5 + (i * 31 % 9 - 4) * 3.0, 7.0 * i % 19 + (i * 23 % 5 - 2) * 5.0) for p in (0, 1) for i in range(40)]
    segs += [(0, 100 + w[1], *w[2:]) for w in wires[:25:4]] * 2 + [(0, 90, None, 1.0, 2.0, 1.0), (0, 91, 6.0, 10.0, 6.0, 10.0)]
    want = {}
    for p, _, x1, y1, x2, y2 in wires[:-1]:
        length = math.hypot(x2 - x1, y2 - y1)
        n = max(1, math.ceil(length / 1.5))
        for k in range(n):
            t = (k + 0.5) / n
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            for q, _, a1, b1, a2, b2 in segs:
                if q == p and a1 is not None and math.floor(x / 20) in cells(a1, a2) and math.floor(y / 20) in cells(b1, b2):
                    dx, dy, square = a2 - a1, b2 - b1, max((a2 - a1) ** 2 + (b2 - b1) ** 2, 1e-9)
                    slack = 0.8 / max(math.hypot(dx, dy), 1e-6)
                    if abs((x - a1) * dy - (y - b1) * dx) / math.sqrt(square) <= 0.8 and -slack <= ((x - a1) * dx + (y - b1) * dy) / square <= 1 + slack:
                        want[p] = want.get(p, 0) + length / n
                        break
    frame = lambda rows, key: spark.createDataFrame([(0, *r, 0) for r in rows], f"doc long, page long, {key} long, x1 double, y1 double, x2 double, y2 double, net long")
    w, s = frame(wires, "wire_id"), frame(segs, "seg_id")
    n = F.greatest(F.lit(1), F.ceil(evaluation_jobs._length() / 1.5)).cast("int")
    got = {r["page"]: r["on"] for r in evaluation_jobs._covered(w.withColumns({"n": n, "piece": evaluation_jobs._length() / n}), s).collect()}
    assert got == pytest.approx(want) and max(math.hypot(r[4] - r[2], r[5] - r[3]) for r in wires[:-1]) > 64 * 1.5
