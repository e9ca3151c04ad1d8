"""Bookmark trees, page figures, searches and score sheets against DuckDB and worked examples."""

import pytest
from test_queries import SF, duck, rows_of  # noqa: F401

from tracewright.jobs import catalog, summary_jobs
from tracewright.operators import bookmarks, pens
from tracewright.operators import summaries as S


@pytest.mark.parametrize("name", list(summary_jobs.JOBS))
def test_query_equals_duckdb(spark, duck, name):  # noqa: F811
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalog.ORACLES[name])
    assert got == rows_of([d[0] for d in r.description], r.fetchall())
    assert got[1]
    spark.catalog.clearCache()


TREE = "doc long, node long, parent long, title string, page long"


def test_odd_trees(spark):
    tree = [(0, 0, None, "Top", None), (0, 1, 0, "Sheet", 3), (0, 2, 1, " Nets (1) ", None), (0, 3, 2, "A ", None), (0, 4, 3, "Pins (1)", None), (0, 5, 4, " R1-1", None), (0, 6, 2, "bare", None), (0, 7, 1, "Components", None),
            (0, 8, 7, "R1", None), (0, 9, 8, "R1-1", None), (0, 10, 7, "Q1", None), (0, 20, 0, "no page", -1), (0, 21, 20, "Nets", None), (0, 22, 21, "B", None), (0, 23, 22, "Pins", None), (0, 24, 23, "x", None),
            (0, 30, 0, None, 4), (0, 31, 30, None, None), (1, 0, None, "Sheet", 0), (1, 1, 0, "Components", None), (1, 2, 1, "R1", None)]
    df = spark.createDataFrame(tree, TREE)
    assert [tuple(r) for r in bookmarks.outline_nets(df).collect()] == [(0, 3, "A", ["R1-1"])]
    assert sorted(tuple(r) for r in bookmarks.outline_parts(df).collect()) == [(0, 3, "Q1", []), (0, 3, "R1", ["1"])]
    assert bookmarks.outline_nets(df.limit(0)).count() == 0 and bookmarks.outline_parts(df.limit(0)).count() == 0


def test_search_order_and_blank_queries(spark):
    items = spark.createDataFrame([(0, 1, ["ab", "x"]), (0, 2, ["A"]), (0, 3, ["bA"]), (0, 4, ["a"]), (0, 5, []), (0, 6, None)], "doc long, place long, names array<string>")
    got = sorted((r["hit"], r["place"], r["rank"], r["exact"]) for r in S.search(items, [" a ", ""], ["doc"]).collect())
    assert got == [(1, 2, 0, 2), (2, 4, 0, 2), (3, 1, 1, 2), (4, 3, 2, 2)]
    assert S.search(items, [" "], ["doc"]).count() == 0 and S.search(items.limit(0), ["a"], ["doc"]).count() == 0


def test_scores_skip_undefined_pages(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0, 0, 0.5, nan, 3), (0, 1, 1.0, 0.5, 4), (0, 2, None, 1.0, 9), (0, 3, 0.0, None, 0)], "doc long, page long, wire_precision double, naming double, phantoms long")
    got = {(r["doc"], r["page"]): tuple(r)[2:] for r in S.score_summary(rows, ["wire_precision", "naming"], ["phantoms"]).collect()}
    assert got == {(0, 0): (0.5, None, 3), (0, 1): (1.0, 0.5, 4), (0, 3): (0.0, None, 0), (None, None): (0.5, 0.5, 7)}


def test_page_without_rows_and_nulls(spark):
    pages = spark.createDataFrame([(0, 0), (0, 1)], "doc long, page long")
    texts = spark.createDataFrame([(0, 0, 1, "a", "net", None, None), (0, 0, 2, "b", None, None, None), (0, 0, 3, "c", "net", True, None), (0, 0, 4, "d", "net", None, 7)], "doc long, page long, text_id long, str string, kind string, in_body boolean, net_id long")
    nothing = pages.limit(0)
    nets = nothing.selectExpr("doc", "page", "'' as name")
    got = {r["page"]: r.asDict() for r in S.page_summary(pages, nothing, nets, nothing, texts, nothing).collect()}
    assert got[0]["kinds"] == {"": 1, "net": 3} and got[0]["unattached"] == 1 and got[0]["loose"] == ["a"] and not got[0]["vector_text"]
    assert (got[1]["texts"], got[1]["kinds"], got[1]["loose"], got[1]["nets"]) == (0, {}, [], 0)


def test_loose_refs_without_pens(spark):
    text = "doc long, page long, text_id long, str string, kind string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, size double, rot int, color string, in_body boolean, net_id long"
    t = spark.createDataFrame([(0, 0, 1, "PWRLED1", "net", 0.0, 0.0, 9.0, 5.0, 0.0, 5.0, 5.0, 0, None, None, None), (0, 0, 2, "10k", "value", 0.0, 7.0, 9.0, 12.0, 0.0, 12.0, 5.0, 0, None, None, None)], text)
    lines = spark.createDataFrame([], "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    none = spark.createDataFrame([], "doc long, page long, color string")
    assert [r["text_id"] for r in pens.loose_refs_by_pen(t, lines, none, none).collect()] == [1]
    assert pens.loose_refs_by_pen(t.where("kind = 'net'"), lines, none, none).count() == 0
