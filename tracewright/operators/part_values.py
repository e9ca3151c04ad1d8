"""Values of parts from the drawing: what each candidate value costs a part, and the steps that deal values out. Keyed by (doc, page).

``texts``: doc, page, text_id, str, kind, x0, y0, x1, y1, ax, ay, size, rot, color, in_body, net_id. ``refs`` (doc, page, text_id, part): the texts that are references and the part each names, as a part of several
units has several. ``heights`` (doc, page, s): the text height; pages that are not listed have no values. Rows with null boxes meet nothing; a null color or in_body is none; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text_rules import is_power_name
from ..sources.shared import by_page, kept
from .graph import KEY, starts, whole_keys
from .labels import pin_end_in_line, pin_under_text
from .spatial import grid_join, text_box
from .symbols import symbol_between
from .values import grouped, value_assign

BOX = ["x0", "y0", "x1", "y1"]
CELL = 40.0
#: In text heights: what a part without a value costs, how far a value of the same symbol may lie, how far two left over may.
ALONE, SAME_SYMBOL, LEFT_OVER = 9.0, 100.0, 12.0
_OUT = "doc long, page long, part long, value long"


def _box(r):
    return tuple(r[c] for c in BOX)


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def offers(texts: DataFrame, pin_lines: DataFrame | None = None, field_pens: DataFrame | None = None) -> DataFrame:
    """``texts`` that may be values, with ``plain``: values, and words that name no wire in the pen of part fields (field_pens: doc, page, color; plain is true). A text that stands on a pin line
    (pin_lines: doc, page, seg_id, x1, y1, x2, y2) by more than half its length is none, nor is a word at which a pin line ends."""
    t = texts.where("kind in ('value', 'net')").withColumn("plain", F.col("kind") == "net")
    if field_pens is None:
        t = t.where("not plain")
    else:
        pens = field_pens.select(*KEY, "color").distinct().withColumn("pen", F.lit(True))
        t = t.join(pens, [*KEY, "color"], "left").where(~F.col("plain") | (_yes(F.col("pen")) & F.col("net_id").isNull() & ~is_power_name(F.col("str")))).drop("pen")
    if pin_lines is not None:
        t = t.join(pin_under_text(t, pin_lines).where("cover > 0.5").select(*KEY, "text_id"), [*KEY, "text_id"], "left_anti")
        t = t.join(pin_end_in_line(t.where("plain"), pin_lines), [*KEY, "text_id"], "left_anti")
    return t


def _numbered(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """References with their texts' columns and part_id: the first text of the part, by which it goes from here on."""
    ids = refs.groupBy(*KEY, "part").agg(F.min("text_id").alias("part_id"))
    return refs.select(*KEY, "text_id", "part").join(ids, [*KEY, "part"]).join(texts.select(*KEY, "text_id", *BOX, "ax", "ay", "size", "rot", "color", "in_body"), [*KEY, "text_id"])


def _may(t, o) -> Column:
    """A value inside a body is for references inside one; two known pens must be the same."""
    return ~(_yes(o["in_body"]) & ~_yes(t["in_body"])) & (t["color"].isNull() | o["color"].isNull() | (t["color"] == o["color"]))


def value_candidates(refs: DataFrame, texts: DataFrame, heights: DataFrame, pin_lines: DataFrame | None = None, field_pens: DataFrame | None = None, homes: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """(doc, page, part, turn, value, gap, cost): the values within six heights of a reference text (turn) of a part, by number of text; past 3.2 heights only those squarely above, below or beside it.

    The cost is the gap between the boxes, and in text heights: 1.5 more for plain words, 0.8 for another turn, 3 where the page knows symbols (homes: doc, page, text_id, symbol) and the two don't share one; 1.5 less on one line
    with the reference - or a tenth of the gap, if that is less, with a symbol's box (boxes: doc, page, x0 ..) between them - and 1.5 less where two parts of one letter have a candidate at this very offset. It is
    never under a twentieth of the gap."""
    o = offers(texts, pin_lines, field_pens).select(*KEY, "text_id", "plain", *BOX, "ax", "ay", "rot", "color", "in_body")
    return _priced(_numbered(refs, texts).join(heights.select(*KEY, "s"), KEY), o, homes, boxes)


def _priced(r: DataFrame, o: DataFrame, homes: DataFrame | None, boxes: DataFrame | None) -> DataFrame:
    """The candidates of numbered references with the text height of their page (s) among the offers."""
    r = r.withColumn("reach", 6 * F.greatest("s", "size"))
    gap = lambda t, v: G.box_gap(_box(t), _box(v))

    def near(t, v):
        cx, cy = F.abs(t["x0"] + t["x1"] - v["x0"] - v["x1"]) / 2, F.abs(t["y0"] + t["y1"] - v["y0"] - v["y1"]) / 2
        lined = F.least(cx, cy, F.abs(t["x0"] - v["x0"]), F.abs(t["y1"] - v["y1"])) <= t["size"] * 0.6
        g = gap(t, v)
        return (t["text_id"] != v["text_id"]) & _may(t, v) & (g <= t["reach"]) & ((g <= 3.2 * F.greatest(t["s"], t["size"])) | lined)

    grown = tuple(F.col(c) + F.col("reach") * (1 if c[1] == "1" else -1) for c in BOX)
    j = grid_join(r, o, KEY, grown, text_box(), CELL, near)
    t, v = F.col("l"), F.col("r")
    level = (t["rot"] == 0) | (F.abs(t["rot"]) == 180)
    line = (t["rot"] == v["rot"]) & (F.abs(F.when(level, v["ay"] - t["ay"]).otherwise(v["ax"] - t["ax"])) <= t["size"] * 0.25)
    letters = F.upper(F.regexp_extract(t["part"], r"^\*?[A-Za-z]*", 0))
    p = j.select("l.doc", "l.page", t["part_id"].alias("part"), t["text_id"].alias("turn"), v["text_id"].alias("value"), t["s"].alias("s"), gap(t, v).alias("gap"), line.alias("line"), v["plain"].alias("plain"),
                 (t["rot"] == v["rot"]).alias("upright"), F.struct(letters.alias("letters"), t["rot"].alias("a"), v["rot"].alias("b"), _round(v["ax"] - t["ax"]).alias("dx"), _round(v["ay"] - t["ay"]).alias("dy")).alias("off"),
                 *[t[c].alias(f"a{c}") for c in BOX], *[v[c].alias(f"b{c}") for c in BOX])
    p = kept(p, "value-pairs")
    far = F.lit(False)
    if homes is not None:
        h = lambda n, c: homes.select(*KEY, F.col("text_id").alias(n), F.col("symbol").alias(c))
        p = p.join(h("turn", "of_ref"), [*KEY, "turn"], "left").join(h("value", "of_value"), [*KEY, "value"], "left")
        p = p.join(homes.select(*KEY).distinct().withColumn("symbols", F.lit(True)), KEY, "left")
        far = _yes(F.col("symbols")) & ~_yes(F.col("of_ref") == F.col("of_value"))
    s = F.col("s")
    cost = F.col("gap") + F.when(F.col("plain"), 1.5 * s).otherwise(0.0) + F.when(F.col("upright"), 0.0).otherwise(0.8 * s) + F.when(far, 3 * s).otherwise(0.0)
    through = F.lit(False)
    if boxes is not None:
        on_line = p.where("line").select(*KEY, F.col("turn").alias("a"), F.col("value").alias("b"), *[f"a{c}" for c in BOX], *[f"b{c}" for c in BOX])
        between = symbol_between(on_line, boxes).select(*KEY, F.col("a").alias("turn"), F.col("b").alias("value"), F.lit(True).alias("through"))
        p = p.join(between, [*KEY, "turn", "value"], "left")
        through = _yes(F.col("through"))
    cost = F.when(~F.col("line"), cost).when(through, F.least(cost, F.col("gap") * 0.1)).otherwise(cost - 1.5 * s)
    # Fields of copied parts sit alike: offsets that two parts of a page have. Counted first, then joined, so that an offset of many parts is no large group.
    often = p.select(*KEY, "off", "part").distinct().groupBy(*KEY, "off").agg(F.count("*").alias("parts")).where("parts >= 2").select(*KEY, "off", F.lit(True).alias("often"))
    p = p.withColumn("cost", cost).join(often, [*KEY, "off"], "left")
    cost = F.greatest(F.col("cost") - F.when(_yes(F.col("often")), 1.5 * s).otherwise(0.0), F.col("gap") * 0.05)
    return p.select(*KEY, "part", "turn", "value", "gap", cost.alias("cost"))


def in_turn(pairs: DataFrame, mutual: bool = False) -> DataFrame:
    """(doc, page, part, value): from the first turn on, each part that has none yet takes its nearest free value; ties go to the lower number. ``pairs``: doc, page, part, turn, value, d. With ``mutual``
    only a value whose own nearest turn, of parts without a value, is this one. A task solves a few pages at a time, group by group of pairs that share parts or values."""

    def of_group(rows: list[tuple]) -> list[tuple]:
        rivals: dict[int, list[tuple]] = {}
        for turn, _, value, part in sorted(rows, key=lambda r: (r[2], r[1], r[0])) if mutual else ():
            rivals.setdefault(value, []).append((turn, part))
        took: dict[int, int] = {}
        gone: set[int] = set()
        tried = None
        for turn, _, value, part in rows:
            if part in took or value in gone or turn == tried:
                continue
            tried = turn  # a turn that finds its nearest free value nearer to another one takes no further value
            if not mutual or next(t for t, p in rivals[value] if p not in took) == turn:
                took[part] = value
                gone.add(value)
        return list(took.items())

    def solve(t: pa.Table, first: np.ndarray):
        doc, page, part, turn, value, d = (t.column(c).to_numpy() for c in (*KEY, "part", "turn", "value", "d"))
        at, took = [], []
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True):
            got = of_group(list(zip(*(c[a:z].tolist() for c in (turn, d, value, part)), strict=True))) if z > a + 1 else [(part[a], value[a])]
            at += [a] * len(got)
            took += got
        took = np.array(took, np.int64).reshape(-1, 2)
        return doc[at], page[at], took[:, 0], took[:, 1]

    return grouped(pairs.select(*[F.col(c).cast("long") for c in (*KEY, "part", "turn", "value")], "d"), ["turn", "d", "value"], solve, _OUT)


def by_symbol(refs: DataFrame, values: DataFrame, homes: DataFrame, heights: DataFrame) -> DataFrame:
    """(doc, page, part, value): in the order of their texts, references (doc, page, text_id, part_id, x0 .., color, in_body) take the nearest free value (doc, page, text_id, x0 .., color, in_body) of their own symbol, closer than
    SAME_SYMBOL heights. A task walks through the texts of a few symbols at a time; no list of their pairs is made."""
    cols = ["text_id", *BOX, "color", "in_body"]
    h = homes.select(*KEY, "text_id", "symbol")
    a = refs.select(*KEY, *cols, "part_id").join(h, [*KEY, "text_id"]).join(heights.select(*KEY, "s"), KEY)
    b = values.select(*KEY, *cols).join(h, [*KEY, "text_id"])
    side = lambda t, part, s: t.select(*[F.col(c).cast("long") for c in (*KEY, "symbol")], part.cast("long").alias("part"), "text_id", *BOX, "color", F.coalesce("in_body", F.lit(False)).alias("in_body"), s.alias("s"))
    both = by_page(side(a, F.col("part_id"), F.col("s")).unionByName(side(b, F.lit(None), F.lit(None).cast("double"))))

    def walk(batches):
        for t in whole_keys(batches, 3):
            doc, page, symbol, text, x0, y0, x1, y1 = (t.column(c).to_numpy() for c in (*KEY, "symbol", "text_id", *BOX))
            value, inside, reach = t.column("part").is_null().to_numpy(), t.column("in_body").to_numpy(), t.column("s").to_numpy() * SAME_SYMBOL
            part = t.column("part").fill_null(-1).to_numpy()
            names: dict[str, int] = {}
            color = np.array([-1 if c is None else names.setdefault(c, len(names)) for c in t.column("color").to_pylist()])
            first = np.flatnonzero(starts(doc, page, symbol))
            got: list[tuple[int, int]] = []
            for i, z, n in zip(first.tolist(), [*first[1:].tolist(), len(doc)], np.add.reduceat(value, first, dtype=np.int64).tolist(), strict=True):
                m, took = i + n, set()  # values come first
                if not n or m == z:
                    continue
                free, v = np.ones(n, bool), slice(i, m)
                for r in range(m, z):
                    if part[r] in took or not free.any():
                        continue
                    ok = free & (~inside[v] | inside[r]) & ((color[v] == -1) | (color[v] == color[r]) | (color[r] == -1))
                    d = np.where(ok, np.hypot(np.maximum(0, np.maximum(x0[v] - x1[r], x0[r] - x1[v])), np.maximum(0, np.maximum(y0[v] - y1[r], y0[r] - y1[v]))), np.inf)
                    k = int(d.argmin())
                    if d[k] < reach[r]:
                        free[k] = False
                        took.add(part[r])
                        got.append((r, i + k))
            of = np.array(got, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc[of[:, 0]], page[of[:, 0]], part[of[:, 0]], text[of[:, 1]])], [*KEY, "part", "value"])

    return both.sortWithinPartitions(*KEY, "symbol", F.col("part").isNotNull(), "text_id").mapInArrow(walk, _OUT)


def part_values(refs: DataFrame, texts: DataFrame, heights: DataFrame, pin_lines: DataFrame | None = None, field_pens: DataFrame | None = None, homes: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """(doc, page, part, value, rule): the value that each part gets, by number of text: ``dealt`` at the least cost of its group, ``symbol`` as the nearest of its own symbol, or ``left`` as one left over and
    nearest both ways within LEFT_OVER heights. ``extra`` is a further field beside the value (package, rating), on pages without field pens: the nearest value nobody has, turned alike and worded otherwise, its centre
    within 3.2 of the reference's size."""
    texts = kept(texts.select(*KEY, "text_id", "str", "kind", *BOX, "ax", "ay", "size", "rot", "color", "in_body", "net_id"), "texts")
    r = kept(_numbered(refs, texts), "references")
    may = kept(offers(texts, pin_lines, field_pens).select(*KEY, "text_id", "plain", *BOX, "ax", "ay", "rot", "color", "in_body"), "offers")
    fields = may.where("not plain").drop("plain")
    homes = None if homes is None else kept(homes.select(*KEY, "text_id", "symbol"), "homes")
    pairs = _priced(r.join(heights.select(*KEY, "s"), KEY), may, homes, boxes).join(heights.select(*KEY, "s"), KEY)
    done = kept(value_assign(pairs.withColumn("cost", F.col("cost") / F.col("s")), ALONE).withColumn("rule", F.lit("dealt")), "dealt")
    pending = lambda done: r.join(done.select(*KEY, F.col("part").alias("part_id")), [*KEY, "part_id"], "left_anti")
    free = lambda done, of: of.join(done.select(*KEY, F.col("value").alias("text_id")), [*KEY, "text_id"], "left_anti")
    if homes is not None:
        done = kept(done.unionByName(by_symbol(pending(done), free(done, fields), homes, heights).withColumn("rule", F.lit("symbol"))), "by-symbol")
    last = pending(done).join(heights.select(*KEY, "s"), KEY).withColumn("reach", F.col("s") * LEFT_OVER)
    gap = lambda t, v: G.box_gap(_box(t), _box(v))
    grown = tuple(F.col(c) + F.col("reach") * (1 if c[1] == "1" else -1) for c in BOX)
    v = free(done, fields).select(*KEY, "text_id", *BOX, "color", "in_body")
    j = grid_join(last, v, KEY, grown, text_box(), CELL, lambda t, o: _may(t, o) & (gap(t, o) < t["reach"]))
    left = in_turn(j.select("l.doc", "l.page", F.col("l.part_id").alias("part"), F.col("l.text_id").alias("turn"), F.col("r.text_id").alias("value"), gap(F.col("l"), F.col("r")).alias("d")), mutual=True)
    done = kept(done.unionByName(left.withColumn("rule", F.lit("left"))), "values")
    first = done.join(texts.select(*KEY, F.col("text_id").alias("value"), F.col("str").alias("first")), [*KEY, "value"]).select(*KEY, F.col("part").alias("part_id"), "first")
    t = r.join(first, [*KEY, "part_id"])
    if field_pens is not None:
        t = t.join(field_pens.select(*KEY).distinct(), KEY, "left_anti")
    others = free(done, texts.where("kind = 'value'")).select(*KEY, "text_id", "str", "rot", *BOX)
    apart = lambda a, b: F.hypot((b["x0"] + b["x1"] - a["x0"] - a["x1"]) / 2, (b["y0"] + b["y1"] - a["y0"] - a["y1"]) / 2)
    meets = lambda a, b: (b["x0"] <= a["x1"] + a["size"] * 4) & (b["x1"] >= a["x0"] - a["size"] * 4) & (b["y0"] <= a["y1"] + a["size"] * 3) & (b["y1"] >= a["y0"] - a["size"] * 3)
    around = tuple(F.col(c) + F.col("size") * w for c, w in zip(BOX, (-4, -3, 4, 3), strict=True))
    j = grid_join(t, others, KEY, around, text_box(), CELL, lambda a, b: (a["rot"] == b["rot"]) & (a["first"] != b["str"]) & meets(a, b) & (apart(a, b) < a["size"] * 3.2))
    more = in_turn(j.select("l.doc", "l.page", F.col("l.part_id").alias("part"), F.col("l.text_id").alias("turn"), F.col("r.text_id").alias("value"), apart(F.col("l"), F.col("r")).alias("d")))
    return done.unionByName(more.withColumn("rule", F.lit("extra")))


def components(refs: DataFrame, texts: DataFrame, values: DataFrame) -> DataFrame:
    """(doc, page, ref, text_ids, values): each part of a page with its texts in their order and the words of its values (as ``part_values`` gives them), a further field last. ``components_with_links``
    completes them by part links."""
    own = refs.groupBy(*KEY, "part").agg(F.min("text_id").alias("part_id"), F.array_sort(F.collect_set("text_id")).alias("text_ids"))
    said = values.join(texts.select(*KEY, F.col("text_id").alias("value"), "str"), [*KEY, "value"])
    said = said.groupBy(*KEY, F.col("part").alias("part_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("rule") == "extra").alias("k"), "str"))), lambda x: x["str"]).alias("values"))
    return own.join(said, [*KEY, "part_id"], "left").select(*KEY, F.col("part").alias("ref"), "text_ids", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
