"""Near-duplicate embeddings within a label: PCA-ordered tiled comparison with suffix-norm bounds, exact in the end.

Unit vectors are rotated onto the principal axes of all vectors, so that leading dimensions hold most of a product. Cells of the first
coordinate, as wide as two linked vectors can lie apart, restrict which vectors are compared; large cells are cut into blocks. In a
tile the leading dimensions are accumulated first; a pair is given up as soon as its partial product plus the product of
the two suffix norms cannot reach the threshold. Pairs that remain get their cosine from the original components in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, min_labels, runs, written

#: Dimensions accumulated between two tests; vectors of a block (what a task holds twice); vectors of a block compared at once; pairs whose components are gathered at once.
STEP, BLOCK, ROWS, PAIRS = 8, 2048, 512, 1 << 16
#: Slack of the bounds for rounding, far over 64 units in the last place.
SLACK = 1e-9


def usable(v: np.ndarray | None) -> bool:
    return v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(np.any(v != 0))


def principal_axes(vecs: DataFrame) -> dict[int, np.ndarray]:
    """For each number of dimensions the orthonormal axes of all usable unit vectors, leading ones first. Tasks send one matrix each, summed
    by Spark; the driver gets one d x d matrix for each d, whatever the number of vectors."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for v in b.column(0).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                if usable(x):
                    x /= np.linalg.norm(x)
                    sums.setdefault(len(x), []).append(x)
            for d, rows in sums.items():
                if isinstance(rows, list) and rows:
                    m = np.stack([r for r in rows if r.ndim == 1]) if any(r.ndim == 1 for r in rows) else np.empty((0, d))
                    old = [r for r in rows if r.ndim == 2]
                    sums[d] = [sum(old) + m.T @ m] if old else [m.T @ m]
        for d, (s,) in sums.items():
            for i in range(d):
                yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([i] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(s[i])], ["d", "i", "j", "c"])

    rows = vecs.select("embedding").mapInArrow(run, "d int, i int, j int, c double").groupBy("d", "i", "j").agg(F.sum("c").alias("c")).toArrow()
    at, i, j, c = (rows[k].to_numpy() for k in ("d", "i", "j", "c"))
    out = {int(d): np.zeros((d, d)) for d in np.unique(at)}
    for d, m in out.items():
        m[i[at == d], j[at == d]] = c[at == d]
    return {d: np.linalg.eigh(c)[1][:, ::-1] for d, c in out.items()}


def linked(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) whose cosine is at least threshold. x, y: original components; ux, uy: rotated units."""
    sx = np.sqrt(np.maximum(np.cumsum(ux[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    sy = np.sqrt(np.maximum(np.cumsum(uy[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
    d, cut = ux.shape[1], min(STEP, ux.shape[1])
    dot = ux[:, :cut] @ uy[:, :cut].T
    i, j = np.nonzero(dot + (np.outer(sx[:, cut], sy[:, cut]) if cut < d else 0) >= threshold - SLACK)
    part = dot[i, j]
    while cut < d and len(i):
        stop = min(cut + STEP, d)
        part = part + _products(ux[:, cut:stop], uy[:, cut:stop], i, j)
        cut = stop
        keep = part + (sx[i, cut] * sy[j, cut] if cut < d else 0) >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    nx, ny = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    keep = _products(x, y, i, j) / (nx[i] * ny[j]) >= threshold
    return i[keep], j[keep]


def _products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The products of the pairs (i of x, j of y); components are gathered for PAIRS pairs at a time."""
    parts = [np.einsum("ij,ij->i", x[i[at : at + PAIRS]], y[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


TILE = ["label", "d", "c1", "c2", "t1", "t2"]


def _compare(threshold: float, axes):
    def tile(c):
        side, node, copies = c["side"], c["node"], c["copies"]
        x = np.stack(c["v"])
        u = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes.value[x.shape[1]]
        alone = c["c1"][0] == c["c2"][0] and c["t1"][0] == c["t2"][0]
        a = np.arange(len(x)) if alone else np.flatnonzero(side == 0)
        b = a if alone else np.flatnonzero(side == 1)
        i_s, j_s = [], []
        for at in range(0, len(a), ROWS):
            part = a[at : at + ROWS]
            i, j = linked(x[part], x[b], u[part], u[b], threshold)
            i_s.append(part[i])
            j_s.append(b[j])
        i, j = np.concatenate(i_s or [a]), np.concatenate(j_s or [a])
        n = np.bincount(i, copies[j], minlength=len(x))
        if not alone:
            n += np.bincount(j, copies[i], minlength=len(x))
        elif len(i):
            n -= np.bincount(i[i == j], copies[i[i == j]], minlength=len(x))  # itself and its copies are counted elsewhere
        lab = min_labels(len(x), i, j)
        return node, node[lab], n.astype(np.int64)

    def run(batches):
        for c, bounds in runs(batches, TILE):
            got = [tile({k: v[i:j] for k, v in c.items()}) for i, j in bounds if j - i > 1]
            node, root, n = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 3
            some = (n > 0) | (node != root)
            yield pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (node, root, n)], ["node", "root", "n"])

    return run


def near_duplicates(vecs: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vecs`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine is at least ``threshold`` (over 0). Vectors that are null, empty, zero or
    hold null or non-finite components, and those with a null label or a null vec_id, link with nothing: no links, component = vec_id. Vectors of different
    lengths do not link. Equal vectors of a label are compared once and count as often as they occur. Repeated rows are vectors of their own.
    """
    rows = vecs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = "embedding is null or label is null or vec_id is null or size(embedding) = 0 or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(embedding, x -> x = 0)"
    rows = written(rows.withColumn("ok", ~F.coalesce(F.expr(bad), F.lit(True))), "vectors")
    distinct = rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    axes = distinct.sparkSession.sparkContext.broadcast(principal_axes(rows.where("ok")))
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK  # units with that cosine lie no further apart

    def rotate(batches):
        for b in batches:
            v = b.column(0).to_pylist()
            first = [float(np.array(x) @ axes.value[len(x)][:, 0] / np.linalg.norm(x)) for x in v]
            cells = pa.array([int(np.floor(x / width)) for x in first], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in v], pa.int32()), cells], ["v", "label", "node", "copies", "d", "cell"])

    cast = distinct.select(F.col("embedding").alias("v"), "label", "node", "copies")
    units = written(cast.mapInArrow(rotate, "v array<double>, label long, node long, copies long, d int, cell int"), "units")
    size = units.groupBy("label", "d", "cell").agg(F.count("*").alias("n"))
    size = size.select("label", "d", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shift = size.select("label", "d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("by"), "cell", "blocks").withColumn("cell", F.col("cell") - F.col("by"))
    around = shift.groupBy("label", "d", "cell").agg(*[F.max(F.when(F.col("by") == k, F.col("blocks"))).alias(n) for k, n in ((-1, "below"), (0, "here"), (1, "above"))])
    x = units.join(around, ["label", "d", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("here")).cast("int"))
    seq = lambda n: F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)
    one = lambda c1, c2, t1, t2, side: F.struct(c1.alias("c1"), c2.alias("c2"), t1.alias("t1"), t2.alias("t2"), side.alias("side"))
    cell, own = F.col("cell"), F.col("own")
    inside = F.transform(seq("here"), lambda t: one(cell, cell, F.least(own, t), F.greatest(own, t), (own > t).cast("int")))
    up = F.when(F.col("above").isNotNull(), F.transform(seq("above"), lambda t: one(cell, cell + 1, own, t, F.lit(0))))
    down = F.when(F.col("below").isNotNull(), F.transform(seq("below"), lambda t: one(cell - 1, cell, t, own, F.lit(1))))
    empty = F.filter(inside, lambda _: F.lit(False))
    tiles = x.select("label", "d", "node", "copies", "v", F.explode(F.concat(inside, F.coalesce(up, empty), F.coalesce(down, empty))).alias("t"))
    tiles = tiles.select("label", "d", "t.*", "node", "copies", "v").repartition(*TILE).sortWithinPartitions(*TILE)
    found = written(tiles.mapInArrow(_compare(threshold, axes), "node long, root long, n long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comp = components(found, "node", "root").withColumnRenamed("node", "of")
    classes = units.select("v", "label", "node", "copies").join(counts, "node", "left").join(comp, F.col("node") == F.col("of"), "left")
    classes = classes.select(F.col("v").alias("cv"), F.col("label").alias("cl"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good, rest = rows.where("ok"), rows.where("not ok")
    out = good.join(classes, (F.col("embedding") == F.col("cv")) & (F.col("label") == F.col("cl")), "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
