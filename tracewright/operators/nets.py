"""Nets: built from components, named by their labels, rolled up over the drawing and listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import is_bare_voltage, is_power_name, natural_key
from ..sources.shared import by_page
from .graph import connected_components, same_name_edges
from .spatial import contacts, label_along_wire


def number_nets(components: DataFrame, spread: bool = False) -> DataFrame:
    """``components`` with net_id: nets of a page counted from 0 in the order of their first segment. They are ranked in one pass over a page; with ``spread`` only its roots are, which reads the components twice."""
    if not spread:
        return components.withColumn("net_id", (F.dense_rank().over(Window.partitionBy("doc", "page").orderBy("root")) - 1).cast("long"))
    roots = components.select("doc", "page", "root").distinct()
    ids = roots.withColumn("net_id", (F.row_number().over(Window.partitionBy("doc", "page").orderBy("root")) - 1).cast("long"))
    return components.join(ids, ["doc", "page", "root"])


def extract(segs: DataFrame, dots: DataFrame, texts: DataFrame, most: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The netlist of each page: segments with net_id, and labels with the segment they lie on and its net. All tables are dealt by page once and stay so; if a page has more
    than ``most`` segments, its cells are dealt instead. What is read more than once and costs more than a join in place is persisted."""
    segs.persist()  # as given, so that texts made of it read the same blocks
    segs, texts = by_page(segs), by_page(texts)
    spread = not segs.groupBy("doc", "page").count().where(F.col("count") > most).isEmpty()
    labels = label_along_wire(texts.where(~is_bare_voltage(F.col("str"))), segs, spread).join(texts.select("doc", "page", "text_id", "str"), ["doc", "page", "text_id"]).persist()
    edges = contacts(segs, dots, spread=spread).unionByName(same_name_edges(labels))
    numbered = number_nets(connected_components(segs, edges), spread).persist()
    wires = segs.join(numbered, ["doc", "page", "seg_id"])
    return wires, labels.join(numbered.select("doc", "page", "seg_id", "net_id"), ["doc", "page", "seg_id"])


def net_build(wires: DataFrame) -> DataFrame:
    """Per net: how many segments it has, which (segs, in their order), and their bounding box."""
    return wires.groupBy("doc", "page", "net_id").agg(
        F.count("*").alias("n_segs"), F.min("seg_id").alias("first_seg"), F.array_sort(F.collect_list("seg_id")).alias("segs"),
        F.min(F.least("x1", "x2")).alias("bx0"), F.min(F.least("y1", "y2")).alias("by0"), F.max(F.greatest("x1", "x2")).alias("bx1"), F.max(F.greatest("y1", "y2")).alias("by1"),
    )


def net_name_pick(labels: DataFrame) -> DataFrame:
    """(doc, page, net_id, name): the best label of a net outside bodies. A port, flag or label on its wire counts 4 (port, true if there is no such column), a
    supply name 2, a flag outline 1 (flag); equal ones go by text, then by text_id."""
    bit = lambda c, default: F.coalesce(F.col(c), F.lit(False)) if c in labels.columns else F.lit(default)
    score = bit("port", True).cast("int") * 4 + is_power_name(F.col("str")).cast("int") * 2 + bit("flag", False).cast("int")
    order = Window.partitionBy("doc", "page", "net_id").orderBy(F.desc("score"), "str", "text_id")
    best = labels.where(~bit("in_body", False)).withColumn("score", score).withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("doc", "page", "net_id", F.col("str").alias("name"))


def named_nets(wires: DataFrame, labels: DataFrame, cad: DataFrame | None = None, ground: DataFrame | None = None) -> DataFrame:
    """Nets with their names: the one that the CAD netlist gives (cad: doc, page, net_id, cad_name), else the best label, else GND for nets at a ground symbol
    (ground: doc, page, net_id), else ""."""
    nets = net_build(wires).drop("segs").join(net_name_pick(labels), ["doc", "page", "net_id"], "left")
    name = F.col("name")
    if cad is not None:
        nets = nets.join(cad.groupBy("doc", "page", "net_id").agg(F.max("cad_name").alias("cad_name")), ["doc", "page", "net_id"], "left")
        name = F.coalesce("cad_name", name)
    if ground is not None:
        nets = nets.join(ground.select("doc", "page", "net_id", F.lit("GND").alias("gnd")).distinct(), ["doc", "page", "net_id"], "left")
        name = F.coalesce(name, "gnd")
    return nets.withColumn("name", F.coalesce(name, F.lit(""))).drop("cad_name", "gnd")


def net_entries(nets: DataFrame, labels: DataFrame) -> DataFrame:
    """Per drawing and name in any case: the name as first seen, whether it is a supply, pages (from 1), nets, segments, and labels that spell the name."""
    spelled = labels.join(nets.select("doc", "page", "net_id", "name"), ["doc", "page", "net_id"]).where(F.upper("str") == F.upper("name")).groupBy("doc", F.upper("name").alias("key")).agg(F.count("*").alias("labels"))
    rolled = nets.where("name <> ''").groupBy("doc", F.upper("name").alias("key")).agg(
        F.min_by("name", F.struct("doc", "page", "net_id")).alias("net"), F.count("*").alias("n_nets"), F.sum("n_segs").alias("n_segs"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.col("page") + 1)), lambda p: p.cast("string")), " ").alias("pages"),
    )
    out = rolled.join(spelled, ["doc", "key"], "left")
    return out.select("doc", "net", F.when(is_power_name(F.col("net")), "power").otherwise("signal").alias("type"), F.coalesce("labels", F.lit(0)).alias("labels"), "pages", "n_nets", "n_segs")


def net_list_order(entries: DataFrame) -> DataFrame:
    """``entries`` with their place in the list of the drawing: supplies first, then in natural order."""
    order = Window.partitionBy("doc").orderBy(F.when(F.col("type") == "power", 0).otherwise(1), natural_key(F.col("net")), "net")
    return entries.withColumn("place", F.row_number().over(order))
