"""Values of parts against DuckDB and a plain walk over each page."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import SF, duck, rows_of  # noqa: F401

from tracewright.jobs import catalog, part_value_jobs
from tracewright.operators import part_values as V
from tracewright.operators import values


@pytest.mark.parametrize("name", ["value_offers", "value_costs"])
def test_query_equals_duckdb(spark, duck, name):  # noqa: F811
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = duck.execute(catalog.ORACLES[name])
    assert got == rows_of([d[0] for d in r.description], r.fetchall())
    assert got[1]


def gap(a, b):
    return math.hypot(max(b["x0"] - a["x1"], 0, a["x0"] - b["x1"]), max(b["y0"] - a["y1"], 0, a["y0"] - b["y1"]))


def may(t, o):
    return not (o["in_body"] and not t["in_body"]) and (not t["color"] or not o["color"] or t["color"] == o["color"])


def walk(refs, texts, usable, homes, dealt, s, pens):
    """One page, step by step. refs: (text, part id) in order; usable: ids of values that may serve; homes: symbol by text; dealt: value by part."""
    out, taken = {p: (v, "dealt") for p, v in dealt.items()}, set(dealt.values())
    fields = [t for t in texts if t["text_id"] in usable]
    for t, part in refs if homes else []:
        near = [(gap(t, o), o["text_id"]) for o in fields if part not in out and o["text_id"] not in taken and t["text_id"] in homes and homes.get(o["text_id"]) == homes[t["text_id"]] and may(t, o)]
        if near and min(near)[0] < 100 * s:
            out[part] = (min(near)[1], "symbol")
            taken.add(min(near)[1])
    left = [(t, p) for t, p in refs if p not in out]
    for t, part in left:
        near = [(gap(t, o), o["text_id"]) for o in fields if part not in out and o["text_id"] not in taken and may(t, o) and gap(t, o) < 12 * s]
        if near:
            o = next(o for o in fields if o["text_id"] == min(near)[1])
            back = min((gap(r, o), r["text_id"]) for r, p in left if p not in out and may(r, o) and gap(r, o) < 12 * s)
            if back[1] == t["text_id"]:
                out[part] = (o["text_id"], "left")
                taken.add(o["text_id"])
    by_id, more = {t["text_id"]: t for t in texts}, {}
    for t, part in refs:
        if pens or part not in out or part in more:
            continue
        mid = lambda x: ((x["x0"] + x["x1"]) / 2, (x["y0"] + x["y1"]) / 2)
        near = [(math.dist(mid(t), mid(o)), o["text_id"]) for o in texts if o["kind"] == "value" and o["rot"] == t["rot"] and o["text_id"] not in taken and o["str"] != by_id[out[part][0]]["str"]]
        if near and min(near)[0] < 3.2 * t["size"]:
            more[part] = min(near)[1]
            taken.add(more[part])
    return {(p, v, rule) for p, (v, rule) in out.items()} | {(p, v, "extra") for p, v in more.items()}


@pytest.mark.parametrize("with_homes", [True, False])
def test_steps_equal_a_plain_walk(spark, with_homes):
    refs, texts, heights, lines, pens, homes, boxes = part_value_jobs._inputs(spark, SF)
    homes, boxes = (homes, boxes) if with_homes else (None, None)
    got = defaultdict(set)
    for r in V.part_values(refs, texts, heights, lines, pens, homes, boxes).collect():
        got[r["doc"], r["page"]].add((r["part"], r["value"], r["rule"]))
    costs = V.value_candidates(refs, texts, heights, lines, pens, homes, boxes).withColumn("cost", F.col("cost") / 5)
    dealt = defaultdict(dict)
    for r in values.value_assign(costs, 9.0).collect():
        dealt[r["doc"], r["page"]][r["part"]] = r["value"]
    usable, symbols, pages, parts = defaultdict(set), defaultdict(dict), defaultdict(list), defaultdict(list)
    for r in V.offers(texts, lines).where("kind = 'value'").collect():
        usable[r["doc"], r["page"]].add(r["text_id"])
    for r in homes.collect() if with_homes else []:
        symbols[r["doc"], r["page"]][r["text_id"]] = r["symbol"]
    for r in texts.orderBy("text_id").collect():
        pages[r["doc"], r["page"]].append(r)
    for r in refs.orderBy("text_id").collect():
        parts[r["doc"], r["page"]].append((r["text_id"], r["part"]))
    rules = set()
    for page, rows in pages.items():
        first = {}
        for i, p in parts[page]:
            first.setdefault(p, i)
        of = {t["text_id"]: t for t in rows}
        want = walk([(of[i], first[p]) for i, p in parts[page]], rows, usable[page], symbols[page], dealt[page], 5.0, page[1] % 2 == 0)
        assert got[page] == want, page
        rules |= {r for _, _, r in want}
    assert {"dealt", "left", "extra"} <= rules
    spark.catalog.clearCache()


TEXT = "doc long, page long, text_id long, str string, kind string, x0 double, y0 double, x1 double, y1 double, ax double, ay double, size double, rot int, color string, in_body boolean, net_id long"


def _text(i, s, kind, x, y, color=None, in_body=None, size=5.0, page=0):
    return (0, page, i, s, kind, x, y - 5, x + 10, y, x, y, size, 0, color, in_body, None)


def test_worked_example(spark):
    # R1 with its value below; C1 beside R1's value with its own in line past a symbol; U1 of two units; a null box
    rows = [_text(1, "R1", "component", 0.0, 0.0), _text(2, "10k", "value", 0.0, 7.0), _text(3, "C1", "component", 100.0, 0.0), _text(4, "1nF", "value", 125.0, 0.0), _text(5, "U1A", "component", 300.0, 0.0),
            _text(6, "U1B", "component", 330.0, 0.0), _text(7, "LM358", "value", 330.0, 7.0), _text(8, "SOT23", "value", 330.0, 12.0), (0, 0, 9, "R9", "component", *[None] * 6, None, None, None, None, None)]
    texts = spark.createDataFrame(rows + rows[:1] * 0, TEXT)
    refs = spark.createDataFrame([(0, 0, 1, "R1"), (0, 0, 3, "C1"), (0, 0, 5, "U1"), (0, 0, 6, "U1"), (0, 0, 9, "R9")], "doc long, page long, text_id long, part string")
    heights = spark.createDataFrame([(0, 0, 5.0)], "doc long, page long, s double")
    boxes = spark.createDataFrame([(0, 0, 112.0, -4.0, 120.0, 0.0)], "doc long, page long, x0 double, y0 double, x1 double, y1 double")
    cost = {(r["turn"], r["value"]): r["cost"] for r in V.value_candidates(refs, texts, heights, boxes=boxes).collect()}
    assert cost[1, 2] == 2.0 and cost[3, 4] == 1.5  # a tenth of the gap of 15
    found = V.part_values(refs, texts, heights, boxes=boxes)
    made = {r["ref"]: (r["text_ids"], r["values"]) for r in V.components(refs, texts, found).collect()}
    assert made == {"R1": ([1], ["10k"]), "C1": ([3], ["1nF"]), "U1": ([5, 6], ["LM358", "SOT23"]), "R9": ([9], [])}
    pens = spark.createDataFrame([(0, 0, "#f00000")], "doc long, page long, color string")
    assert V.part_values(refs, texts, heights, field_pens=pens).where("rule = 'extra'").count() == 0


def test_empty_tables_and_unlisted_pages(spark):
    texts = spark.createDataFrame([_text(1, "R1", "component", 0.0, 0.0), _text(2, "10k", "value", 0.0, 7.0)], TEXT)
    refs = spark.createDataFrame([(0, 0, 1, "R1")], "doc long, page long, text_id long, part string")
    heights = spark.createDataFrame([(0, 1, 5.0)], "doc long, page long, s double")
    assert V.part_values(refs, texts, heights).count() == 0
    assert V.part_values(refs.limit(0), texts.limit(0), heights.limit(0)).count() == 0


def test_in_turn_ties(spark):
    pairs = spark.createDataFrame([(0, 0, 1, 1, 9, 2.0), (0, 0, 1, 1, 8, 2.0), (0, 0, 2, 2, 8, 1.0), (0, 0, 2, 3, 9, 5.0)], "doc long, page long, part long, turn long, value long, d double")
    take = lambda **k: {(r["part"], r["value"]) for r in V.in_turn(pairs, **k).collect()}
    assert take() == {(1, 8), (2, 9)}  # the lower value of equal ones, then part 2 at its second text
    assert take(mutual=True) == {(2, 8)}  # part 1's nearest value is nearer to part 2
    assert not np.any([r for r in V.in_turn(pairs.limit(0)).collect()])
