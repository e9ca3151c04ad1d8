"""Queries on pins of a netlist."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, pins
from ..operators.spatial import contacts
from ..sources.fixtures import tables, with_ctes
from . import oracle as O
from .oracle import gap


def _made(spark, sf):
    return tables(spark, sf, "pin_boxes", "segs", "heights", "parts", "dots")


def _located(spark, sf, made=None):
    p, segs, heights, parts, _ = made or _made(spark, sf)
    net = F.when(F.col("i") % 9 == 0, F.concat(F.lit("NetR"), (F.col("i") % 4).cast("string"))).otherwise(F.concat(F.lit("NET"), (F.col("i") % 9).cast("string")))
    netlist = parts.where("i % 4 <> 3").select("doc", "page", F.col("ref").alias("name"), net.alias("net"))
    return p, netlist, *pins.pin_segments(p, segs, netlist, heights)


def pin_segments(spark, sf):
    return _located(spark, sf)[2]


def pin_stand_ins(spark, sf):
    return _located(spark, sf)[3]


def pin_net_edges(spark, sf):
    p, netlist, located, _ = _located(spark, sf)
    return pins.netlist_edges(located, p, netlist)[0]


def pin_net_names(spark, sf):
    p, netlist, located, _ = _located(spark, sf)
    return pins.netlist_edges(located, p, netlist)[1]


def nets_with_stand_ins(spark, sf):
    """Components of wires and stand-ins under the netlist."""
    made = _made(spark, sf)
    p, netlist, located, stand = _located(spark, sf, made)
    segs = made[1].select("doc", "page", "seg_id", "x1", "y1", "x2", "y2")
    edges = contacts(segs, made[4]).unionByName(pins.netlist_edges(located, p, netlist)[0])
    return graph.connected_components(segs.unionByName(stand), edges)


_SEG = ("least(s.x1, s.x2)", "least(s.y1, s.y2)", "greatest(s.x1, s.x2)", "greatest(s.y1, s.y2)")
_IN = lambda e: f"(s.x{e} BETWEEN b.x0 - 1.5 AND b.x1 + 1.5 AND s.y{e} BETWEEN b.y0 - 1.5 AND b.y1 + 1.5)"
_TO = lambda e: f"CASE WHEN {_IN(e)} THEN sqrt(power(s.x{e} - (b.x0 + b.x1) / 2, 2) + power(s.y{e} - (b.y0 + b.y1) / 2, 2)) END"
_PINS = f"""netlist AS (SELECT doc, page, ref AS name, CASE WHEN i % 9 = 0 THEN 'NetR' || (i % 4) ELSE 'NET' || (i % 9) END AS net FROM parts WHERE i % 4 <> 3),
hit AS MATERIALIZED (SELECT b.doc, b.page, b.pin_id, s.seg_id, least({_TO(1)}, {_TO(2)}) AS e, {gap(('b.x0', 'b.y0', 'b.x1', 'b.y1'), _SEG)} AS d FROM pin_boxes b JOIN segs s ON b.doc = s.doc AND b.page = s.page AND {gap(('b.x0 - 1.5', 'b.y0 - 1.5', 'b.x1 + 1.5', 'b.y1 + 1.5'), _SEG)} <= 0),
ee AS (SELECT doc, page, pin_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, pin_id ORDER BY e, seg_id) AS r FROM hit WHERE e IS NOT NULL) z WHERE r = 1),
pp AS (SELECT doc, page, pin_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, pin_id ORDER BY d, seg_id) AS r FROM hit WHERE d <= 0.15) z WHERE r = 1),
free AS MATERIALIZED (SELECT b.*, (SELECT max(seg_id) FROM segs s WHERE s.doc = b.doc AND s.page = b.page) + row_number() OVER (PARTITION BY b.doc, b.page ORDER BY b.pin_id) AS seg_id FROM pin_boxes b SEMI JOIN netlist n ON b.doc = n.doc AND b.page = n.page AND b.name = n.name ANTI JOIN hit h ON b.doc = h.doc AND b.page = h.page AND b.pin_id = h.pin_id),
located AS MATERIALIZED (SELECT *, false AS own FROM ee UNION ALL SELECT *, false FROM pp p ANTI JOIN ee USING (doc, page, pin_id) UNION ALL SELECT doc, page, pin_id, seg_id, true FROM free),
stand AS (SELECT doc, page, seg_id, CASE WHEN x1 - x0 >= y1 - y0 THEN x0 ELSE (x0 + x1) / 2 END AS x1, CASE WHEN x1 - x0 >= y1 - y0 THEN (y0 + y1) / 2 ELSE y0 END AS y1, CASE WHEN x1 - x0 >= y1 - y0 THEN x1 ELSE (x0 + x1) / 2 END AS x2, CASE WHEN x1 - x0 >= y1 - y0 THEN (y0 + y1) / 2 ELSE y1 END AS y2 FROM free),
on_net AS MATERIALIZED (SELECT l.doc, l.page, l.pin_id, l.seg_id, n.net FROM located l JOIN pin_boxes b USING (doc, page, pin_id) JOIN netlist n USING (doc, page, name)),
star AS MATERIALIZED (SELECT DISTINCT o.doc, o.page, least(o.seg_id, f.src) AS src, greatest(o.seg_id, f.src) AS dst FROM on_net o JOIN (SELECT doc, page, net, arg_min(seg_id, pin_id) AS src FROM on_net GROUP BY doc, page, net) f USING (doc, page, net) WHERE o.seg_id <> f.src)"""
FX = ("segs", "dots", "parts", "heights", "pin_boxes")

JOBS = {
    "pin_segments": (pin_segments, with_ctes(f"{_PINS} SELECT * FROM located", *FX)),
    "pin_stand_ins": (pin_stand_ins, with_ctes(f"{_PINS} SELECT * FROM stand", *FX)),
    "pin_net_edges": (pin_net_edges, with_ctes(f"{_PINS} SELECT * FROM star", *FX)),
    "pin_net_names": (pin_net_names, with_ctes(f"{_PINS} SELECT doc, page, seg_id, arg_max(net, pin_id) AS name FROM on_net WHERE NOT starts_with(net, 'Net') GROUP BY doc, page, seg_id", *FX)),
    "nets_with_stand_ins": (nets_with_stand_ins, with_ctes(f"{_PINS}, {O.CONTACTS}, all_edges AS (SELECT * FROM touch UNION SELECT * FROM star), {O.components('all_edges').replace('FROM segs', 'FROM (SELECT doc, page, seg_id FROM segs UNION ALL SELECT doc, page, seg_id FROM stand) z')} SELECT doc, page, seg_id, root FROM cc", *FX)),
}
