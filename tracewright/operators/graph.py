"""Connected components and greedy choices: per page in one small task, or over joins alone for pages that do not fit one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text_rules import is_power_name
from ..sources.shared import by_page, written

#: Pages are told apart by drawing and page number; edges of a page that one task solves; rows of small pages that are solved at once.
KEY, MOST, ROWS = ["doc", "page"], 2_000_000, 100_000


def whole_keys(batches: Iterator[pa.RecordBatch], key: int, least: int = ROWS) -> Iterator[pa.Table]:
    """The rows of ``batches``, which are sorted by their first ``key`` columns (numbers, never null), again: many small groups at a time, and no group in two tables."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy() for i in range(key)])
        new = (k != np.concatenate([k[:, :1] if last is None else last, k[:, :-1]], axis=1)).any(axis=0)
        last, rows = k[:, -1:], rows + b.num_rows
        held.append(b)
        if rows >= least and new.any():
            cut = int(np.flatnonzero(new)[-1])
            yield pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            held, rows = [b.slice(cut)], b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns begin a new group."""
    return np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(columns[0]) else np.zeros(0, bool)


def components_of(page: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of many pages at once, as (page, node), each with its root, the least node of its page that it is linked with; first where each edge's source is among them."""
    pages, nodes = np.concatenate([page, page]), np.concatenate([src, dst])
    order = np.lexsort([nodes, pages])
    first = starts(pages[order], nodes[order])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(first) - 1
    return at[: len(src)], order[first], _least_reachable(int(first.sum()), at[: len(src)], at[len(src) :])


def _least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, at[i], low)
        np.minimum.at(new, at[j], low)
        new = new[new]
        if np.array_equal(new, at):
            return at
        at = new


def by_joins(edges: DataFrame) -> DataFrame:
    """(doc, page, seg_id, root) of all linked segments. Each round every segment takes its least neighbour, follows it one step and the edges are rewritten
    between what they lead to; a round at least halves what can still merge. Minima are aggregated before the shuffle, so a hub is one more key."""
    e = written(edges.where("src <> dst").select(*KEY, "src", "dst").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select(*KEY, F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = both.groupBy(*KEY, "src").agg(F.min("dst").alias("m")).select(*KEY, F.col("src").alias("seg_id"), F.least("src", "m").alias("p"))
        next_ = up.select(*KEY, F.col("seg_id").alias("p"), F.col("p").alias("root"))
        up = written(up.join(next_, [*KEY, "p"]).select(*KEY, "seg_id", "root"), "parents")
        if labels is None:
            labels = up
        else:
            labels = labels.join(up.select(*KEY, F.col("seg_id").alias("root"), F.col("root").alias("r")), [*KEY, "root"], "left").select(*KEY, "seg_id", F.coalesce("r", "root").alias("root"))
        ends = {c: up.select(*KEY, F.col("seg_id").alias(c), F.col("root").alias(f"{c}2")) for c in ("src", "dst")}
        e = written(e.join(ends["src"], [*KEY, "src"]).join(ends["dst"], [*KEY, "dst"]).where("src2 <> dst2").select(*KEY, F.col("src2").alias("src"), F.col("dst2").alias("dst")).distinct(), "edges")
    return edges.select(*KEY, F.col("src").alias("seg_id"), F.col("dst").alias("root")).limit(0) if labels is None else labels


def connected_components(segs: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """(doc, page, seg_id, root) for every segment: root is the smallest segment of its page that is reachable over ``edges`` (doc, page, src, dst). A task solves a few
    pages at a time; pages with more than ``most`` edges are solved over joins instead. Segments without edges are their own root and never enter a
    task; edges with a null end link nothing. No segments: no rows."""

    def of_pages(batches):
        for t in whole_keys(batches, 2):
            doc, page, src, dst = (t.column(i).to_numpy() for i in range(4))
            new = starts(doc, page)
            _, node, root = components_of(np.cumsum(new), src, dst)
            row, name = node % len(src), np.concatenate([src, dst])[node]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc[row], page[row], name, name[root])], [*KEY, "seg_id", "root"])

    edges = edges.where("src is not null and dst is not null and doc is not null and page is not null").select(*[F.col(c).cast("long") for c in (*KEY, "src", "dst")])
    edges = by_page(edges, KEY).persist()
    crowded = edges.groupBy(*KEY).count().where(F.col("count") > most).select(*KEY)
    schema = "doc long, page long, seg_id long, root long"
    solved = lambda e: e.sortWithinPartitions(*KEY).mapInArrow(of_pages, schema)
    if crowded.isEmpty():
        found = solved(edges)
    else:
        found = solved(edges.join(crowded, KEY, "left_anti")).unionByName(by_joins(edges.join(crowded, KEY, "left_semi")))
    return by_page(segs.select(*KEY, "seg_id"), KEY).join(by_page(found, KEY), [*KEY, "seg_id"], "left").select(*KEY, "seg_id", F.coalesce("root", "seg_id").alias("root"))


def same_name_edges(labels: DataFrame) -> DataFrame:
    """Star edges between the segments of a page whose labels (doc, page, seg_id, str) share a name, in any case: each to the first of its name. Labels inside
    bodies (in_body) do not count, nor do names other than supplies that are only written near a wire (port false)."""
    inside = F.coalesce("in_body", F.lit(False)) if "in_body" in labels.columns else F.lit(False)
    port = F.coalesce("port", F.lit(False)) if "port" in labels.columns else F.lit(True)
    named = labels.where(~inside & (port | is_power_name(F.col("str")))).select(*KEY, "seg_id", F.upper("str").alias("name"))
    first = named.groupBy(*KEY, "name").agg(F.min("seg_id").alias("src"))
    return named.join(first, [*KEY, "name"]).where("src <> seg_id").select(*KEY, "src", F.col("seg_id").alias("dst")).distinct()


def dropped_repeats(links: DataFrame) -> DataFrame:
    """(doc, page, later): of items that repeat an earlier one those that go, if each is compared only with earlier ones that stay. ``links`` (doc, page, earlier,
    later) names the pairs that lie close; a task holds the close pairs of one page, which are few. An item whose earlier neighbours all go stays."""

    def of_page(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["earlier"], pdf["later"], strict=True):
            near.setdefault(b, []).append(a)
        for b in sorted(near):
            if any(a not in gone for a in near[b]):
                gone.add(b)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "page": pdf["page"].iloc[0], "later": sorted(gone)})

    return links.select(*KEY, "earlier", "later").groupBy(*KEY).applyInPandas(of_page, "doc long, page long, later long")
