"""Queries that left out part of their job, against DuckDB and worked examples."""

import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck, rows_of  # noqa: F401

from tracewright.jobs import catalog, net_jobs
from tracewright.operators import nets
from tracewright.operators import summaries as S
from tracewright.sources.fixtures import table


@pytest.mark.parametrize("name", ["doc_counts", "net_build", "page_stats"])
def test_query_equals_duckdb(spark, duck, name):  # noqa: F811
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalog.ORACLES[name])
    assert got == rows_of([d[0] for d in r.description], r.fetchall())
    assert got[1]
    spark.catalog.clearCache()


def test_doc_counts_has_references(spark):
    """distinct references of a drawing, over all its pages."""
    got = {r["doc"]: r["parts"] for r in net_jobs.doc_counts(spark, SF).collect()}
    assert got == {r["doc"]: r["n"] for r in table(spark, SF, "parts").groupBy("doc").agg(F.count_distinct("ref").alias("n")).collect()} and min(got.values()) > 0
    spark.catalog.clearCache()


def test_net_build_lists_segments(spark):
    """a net states its segments, in their order."""
    rows = [(0, 0, i, 1.0 * i, 0.0, i + 1.0, 2.0, net) for i, net in ((11, 0), (2, 0), (7, 1), (30, 0))]
    wires = spark.createDataFrame(rows, "doc long, page long, seg_id long, x1 double, y1 double, x2 double, y2 double, net_id long")
    assert {r["net_id"]: (r["segs"], r["n_segs"], r["first_seg"]) for r in nets.net_build(wires).collect()} == {0: ([2, 11, 30], 3, 2), 1: ([7], 1, 7)}
    assert "segs" not in nets.named_nets(wires, wires.selectExpr("doc", "page", "net_id", "seg_id", "seg_id text_id", "'A' str").limit(0)).columns
    of_page = {r["page"]: sorted(int(s) for s in r["all"].split()) for r in net_jobs.net_build(spark, SF).where("doc = 0").groupBy("page").agg(F.array_join(F.collect_list("segs"), " ").alias("all")).collect()}
    assert of_page == {r["page"]: list(range(r["n"])) for r in table(spark, SF, "segs").where("doc = 0").groupBy("page").agg(F.count("*").alias("n")).collect()}
    spark.catalog.clearCache()


def test_page_stats_is_whole(spark, tmp_path):
    """F8: kinds, dots, the sort of lettering, every label that names no wire (not only the first), and pages without wires."""
    pages = spark.createDataFrame([(0, 0)], "doc long, page long")
    texts = spark.createDataFrame([(0, 0, i, f"T{i}", "net", False, None) for i in range(100)], "doc long, page long, text_id long, str string, kind string, in_body boolean, net_id long")
    none = pages.limit(0)
    row = S.page_summary(pages, none, none.selectExpr("doc", "page", "'' as name"), none, texts, none, most=None).first()
    assert row["loose"] == [f"T{i}" for i in range(100)] and row["unattached"] == 100
    for name in ("orders", "lineitem"):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.where("l_orderkey >= 750" if name == "lineitem" else "true").write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["doc"], r["page"]): r for r in net_jobs.page_stats(spark, str(tmp_path)).collect()}
    assert {(0, p) for p in range(5)} <= set(got) and got[0, 0]["wires"] == 0 and got[0, 0]["dots"] > 0 and "component:" in got[0, 0]["kinds"]
    spark.catalog.clearCache()
