"""Groups and pages that are solved many at a time, against each for itself."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tracewright.jobs import style_jobs
from tracewright.operators import graph, part_values, values
from tracewright.sources import truth


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pairs(spark, pages=40):
    rng = np.random.default_rng(7)
    rows = [(int(d), int(p), int(rng.integers(30)), int(rng.integers(30)), float(rng.integers(1, 60))) for d in range(pages // 5) for p in range(5) for _ in range(int(rng.integers(1, 40)))]
    odd = [(None, 0, 1, 1, 2.0), (0, None, 1, 1, 2.0), (0, 0, None, 1, 2.0), (0, 0, 1, None, 2.0)]
    return rows, spark.createDataFrame(rows + odd, "doc long, page long, part long, value long, cost double")


def test_groups_of_many_pages_are_settled_together(spark):
    """no pandas task for each group; the same pairs as each group for itself, also over joins."""
    rows, df = _pairs(spark)
    plan = _plan(values.value_assign(df, 45.0))
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    want = set()
    for page in {r[:2] for r in rows}:
        least = {}
        for r in rows:
            if r[:2] == page:
                least[r[2], r[3]] = min(least.get(r[2:4], np.inf), r[4])
        left = set(least)
        while left:
            group, grown = {left.pop()}, True
            while grown:
                more = {x for x in left if any(x[0] == g[0] or x[1] == g[1] for g in group)}
                left, group, grown = left - more, group | more, bool(more)
            of = sorted((least[x], *x) for x in group)
            want |= {(*page, a, b) for a, b in values.settled(np.array([x[1] for x in of]), np.array([x[2] for x in of]), np.array([x[0] for x in of]), 45.0)}
    for most in (values.CROWDED, 15):
        assert {tuple(r) for r in values.value_assign(df, 45.0, most).collect()} == want
    assert values.value_assign(df.limit(0), 45.0).count() == 0


def test_components_of_many_pages_are_solved_together(spark):
    """F1, F3, F4 and all readers of components: no pandas task for each page."""
    edges = _pairs(spark)[1].selectExpr("doc", "page", "part src", "value dst")
    nodes = edges.selectExpr("doc", "page", "src seg_id").union(edges.selectExpr("doc", "page", "dst")).distinct()
    found = graph.connected_components(nodes, edges)
    assert "FlatMapGroups" not in _plan(found)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(found) == rows(graph.connected_components(nodes, edges, most=10))


@pytest.mark.parametrize("least", [1, 7, 1000])
def test_no_group_is_cut(least):
    key, n = np.repeat(np.arange(12) // 3, np.arange(12)), 5
    page = np.repeat(np.arange(12), np.arange(12))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + n]), pa.array(page[i : i + n])], ["doc", "page"]) for i in range(0, len(key), n)]
    tables = list(graph.whole_keys(iter([batches[0].slice(0, 0), *batches]), 2, least))
    assert pa.concat_tables(tables).to_pydict() == {"doc": key.tolist(), "page": page.tolist()}
    seen = [set(t.column("page").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == 11 and (least > 7 or len(tables) > 5)


def test_values_by_symbol_are_walked_together(spark):
    """no pandas task for each symbol or group; the texts of a symbol in their order."""
    box = "x0 double, y0 double, x1 double, y1 double, color string, in_body boolean"
    refs = spark.createDataFrame([(0, p, i, 0.0, 10.0 * i, 5.0, 10.0 * i + 5, c, None, i) for p in (0, 1) for i, c in ((2, None), (4, "#a"), (6, "#b"))], f"doc long, page long, text_id long, {box}, part_id long")
    vals = spark.createDataFrame([(0, 0, i, 9.0, y, 12.0, y + 5, c, b) for i, y, c, b in ((1, 20.0, "#b", None), (3, 45.0, None, None), (5, 62.0, "#b", False), (7, 60.0, None, True))], f"doc long, page long, text_id long, {box}")
    homes = spark.createDataFrame([(0, p, i, 9) for p in (0, 1) for i in range(1, 8)], "doc long, page long, text_id long, symbol long")
    heights = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0)], "doc long, page long, s double")
    found = part_values.by_symbol(refs, vals, homes, heights)
    assert "FlatMap" not in _plan(found) and {tuple(r) for r in found.collect()} == {(0, 0, 2, 1), (0, 0, 4, 3), (0, 0, 6, 5)}
    assert found.limit(0).count() == 0 and part_values.by_symbol(refs, vals.limit(0), homes, heights).count() == 0
    pairs = _pairs(spark)[1].selectExpr("doc", "page", "part", "part turn", "value", "cost d")
    assert "FlatMap" not in _plan(part_values.in_turn(pairs, mutual=True))


def test_fit_looks_no_further_than_it_must():
    """the same first best row as all votes give, of which only a part is looked at."""
    rng = np.random.default_rng(3)
    pts = np.round(rng.uniform(0, 60, (300, 2)), 1)
    near, x = truth._Near(np.concatenate([pts, pts])), rng.uniform(0, 60, (200, 80, 2))
    x[[40, 90, 120], :60] = pts[rng.integers(0, 300, (3, 60))]
    assert len(near.pts) == len(np.unique(pts, axis=0))
    every = np.array([[min(math.dist(a, b) for b in pts) <= 0.9 for a in row] for row in x]).sum(axis=1)
    assert near.votes(x, 0.9).tolist() == every.tolist()
    seen = []
    votes, near.votes = near.votes, lambda x, r: seen.append(x.size // 2) or votes(x, r)
    assert near.most_votes(x, 0.9, -1) == (int(every.argmax()), int(every.max())) and sum(seen) < x.size / 4
    assert near.most_votes(x, 0.9, int(every.max()) - 1)[0] == every.argmax() and near.most_votes(x, 0.9, int(every.max())) is None
    found, p = near.nearest(x[0], 0.9)
    assert [math.dist(a, b) for a, b in zip(x[0][found], p)] == pytest.approx([min(math.dist(a, b) for b in pts) for a in x[0][found]]) and found.sum() == every[0]


def test_figures_of_styles_are_made_once(spark):
    """what reads the figures of a page's styles does not make them again from its strokes."""
    plan = _plan(style_jobs.wiring_styles(spark, "/root/testdata/sf0.001"))
    assert "lineitem.parquet" not in plan and "style-stats" in plan
