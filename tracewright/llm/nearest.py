"""Exact top-k by inner product: an index of pivots and distances to them, searched ring by ring and stopped by the triangle inequality.

With M the largest norm, one more component sqrt(M^2 - |v|^2) puts all vectors on a sphere of radius M; for a query with a zero there, the squared distance is
|q|^2 + M^2 - 2 q.v, so the nearest vectors have the highest products. Each vector is keyed by its nearest pivot and its distance to it, and
the sorted keys are cut into blocks: rings around a pivot. A ring [lo, hi] cannot hold a vector within R of a query at distance D from the pivot unless
D - R <= hi and D + R >= lo. The block a query lies in gives its first R, the distance of its k-th best there. Rings within reach are then searched
from the nearest outward; R shrinks as better vectors are found, and queries drop out of rings beyond it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import integer_vectors, matrices, packed, runs, written

#: Pivots of a length; rows the pivots are picked from; vectors of a ring; queries and vectors that a task of the search gets; queries compared at once.
PIVOTS, SAMPLE, RING, QUERIES, VECTORS, ROWS = 64, 4096, 1024, 4096, 16384, 512
#: Slack of distances for rounding, as a share of M.
SLACK = 1e-5
LEAST = int(np.iinfo(np.int64).min)
#: Stands for a null id.
NO_ID = int(np.iinfo(np.int64).max)


def _pivots(rows: DataFrame, top: float) -> dict[int, np.ndarray]:
    """Per length up to PIVOTS points of the sphere, each as far as possible from those before, among SAMPLE vectors taken by a hash. Lengths that the sample lacks have none."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    out = {}
    for _, x in matrices(sample):
        x = np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))])
        chosen, far = [0], np.full(len(x), np.inf)
        while len(chosen) < PIVOTS:
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        out[x.shape[1] - 1] = x[chosen]
    return out


def _centres(pivots: dict, d: int) -> np.ndarray:
    return pivots.get(d, np.zeros((1, d + 1)))


def _distances(x: np.ndarray, last: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of points (x, last), whose squared norms are ``norms``, to the centres."""
    dots = x @ centres[:, :-1].T + np.outer(last, centres[:, -1])
    return np.sqrt(np.maximum(norms[:, None] + (centres**2).sum(axis=1) - 2 * dots, 0))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of integers, exact: in doubles where these hold every sum, in 64-bit integers otherwise."""
    most = (float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0))) * x.shape[1]
    if most < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row; LEAST where there are fewer columns."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if 0 < k <= scores.shape[1] else np.full(len(scores), LEAST)


def _index(rows: DataFrame, pivots, top: float, k: int) -> DataFrame:
    """Rows (rid, key, query, v packed, d, pivot, dist, ring, part, nth, kth), written: rings of RING vectors at most, ``nth`` numbers the queries of a
    partition, ``kth`` is a query's k-th score in its own ring, as far as that has so many."""

    def key(batches):
        for b in batches:
            n = b.num_rows
            size, pivot, dist, cells = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.empty(n, object)
            for at, x in matrices(b.column(3)) if n else ():
                norms, centres = (x**2).sum(axis=1), _centres(pivots.value, x.shape[1])
                far = _distances(x, np.sqrt(np.maximum(top - norms, 0)), np.full(len(x), top), centres)
                size[at], pivot[at] = x.shape[1], far.argmin(axis=1)
                dist[at], cells[at] = far.min(axis=1), [r.tobytes() for r in x.astype("<i4")]
            arrays = [*b.columns[:3], pa.array(cells.tolist(), pa.binary()), *map(pa.array, (size, pivot, dist))]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "key", "query", "v", "d", "pivot", "dist"])

    schema = "rid long, key long, query boolean, v binary, d int, pivot int, dist double"
    order = ["d", "pivot", "dist", "rid"]  # the last one shares out vectors that are equal

    def cut(batches):
        part, ring, nth, last_d = TaskContext.get().partitionId(), 0, 0, None
        for c, bounds in runs(batches, ["d", "pivot"]):
            for i, j in bounds:
                pieces = -(-(j - i) // RING)
                for r in range(pieces):
                    at = slice(i + (j - i) * r // pieces, i + (j - i) * (r + 1) // pieces)
                    d, query, n = int(c["d"][at][0]), c["query"][at].astype(bool), at.stop - at.start
                    x, own = packed(c["v"][at], d), np.flatnonzero(query)
                    best = np.full(n, LEAST)
                    for lo in range(0, len(own), ROWS):
                        s = products(x[own[lo : lo + ROWS]], x)
                        s[np.arange(len(s)), own[lo : lo + ROWS]] = LEAST
                        best[own[lo : lo + ROWS]] = kth(s, k)
                    number = np.where(query, nth + np.cumsum(query) - 1, -1)
                    nth, last_d = nth + len(own), d
                    fixed = [pa.array(np.full(n, v, t)) for v, t in ((part * 2**32 + ring, np.int64), (part, np.int32))]
                    arrays = [pa.array(c["rid"][at]), pa.array(c["key"][at]), pa.array(query), pa.array(c["v"][at].tolist(), pa.binary()), *(pa.array(c[a][at]) for a in ("d", "pivot", "dist")), *fixed, pa.array(number), pa.array(best)]
                    yield pa.RecordBatch.from_arrays(arrays, [*"rid key query v d pivot dist ring part nth kth".split()])
                    ring += 1

    keyed = rows.select("rid", "key", "query", "v").mapInArrow(key, schema)
    return written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, f"{schema}, ring long, part int, nth long, kth long"), "rings")


def _reach(queries: DataFrame, pivots, top: float) -> DataFrame:
    """(d, unit, pivot, a, b): the interval of distances from a pivot within which rings may hold one of the k best of some query of the unit."""
    slack = SLACK * max(np.sqrt(top), 1)

    def run(batches):
        for b in batches:
            c = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            for d, unit in {*zip(c["d"].tolist(), c["unit"].tolist(), strict=True)}:
                at = np.flatnonzero((c["d"] == d) & (c["unit"] == unit))
                x, best = packed(c["v"][at], d).astype(np.float64), c["kth"][at]
                norms, centres = (x**2).sum(axis=1), _centres(pivots.value, d)
                far = _distances(x, np.zeros(len(x)), norms, centres)
                radius = np.where(best == LEAST, np.inf, np.sqrt(np.maximum(norms + top - 2.0 * best, 0)) + slack)[:, None]
                cols = [np.full(len(centres), d, np.int32), np.full(len(centres), unit, np.int64), np.arange(len(centres), dtype=np.int32), (far - radius).min(axis=0), (far + radius).max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["d", "unit", "pivot", "a", "b"])

    out = queries.select("d", "unit", "v", "kth").mapInArrow(run, "d int, unit long, pivot int, a double, b double")
    return out.groupBy("d", "unit", "pivot").agg(F.min("a").alias("a"), F.max("b").alias("b"))


class _Best:
    """The k best of the queries of one unit, over the rings given so far."""

    def __init__(self, c: dict, at: slice, centres: np.ndarray, top: float, k: int):
        self.d, self.k, self.top, self.centres = int(c["d"][at][0]), k, top, centres
        self.rid, self.ids, self.bound = c["rid"][at], c["key"][at], c["kth"][at].copy()
        self.x = packed(c["v"][at], self.d)
        self.norms = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.far = _distances(self.x.astype(np.float64), np.zeros(len(self.x)), self.norms, centres)
        self.slack = SLACK * max(np.sqrt(top), 1)
        self.found = [np.empty(0, np.int64) for _ in range(4)]  # query, score, id, rid

    def ring(self, c: dict, at: slice) -> None:
        dist, far = c["dist"][at], self.far[:, c["pivot"][at][0]]
        low = np.maximum(np.maximum(far - dist.max(), dist.min() - far) - self.slack, 0)
        within = np.flatnonzero((self.norms + self.top - low**2) / 2 >= self.bound.astype(np.float64) - 1 - 1e-9 * self.top)  # the others stop here
        if not len(within):
            return
        y, rid, ids = packed(c["v"][at], self.d), c["rid"][at], c["key"][at]
        order = np.argsort(rid)
        for lo in range(0, len(within), ROWS):
            q = within[lo : lo + ROWS]
            s = products(self.x[q], y)
            own = np.minimum(np.searchsorted(rid, self.rid[q], sorter=order), len(rid) - 1)
            same = rid[order[own]] == self.rid[q]
            s[np.flatnonzero(same), order[own[same]]] = LEAST
            self.bound[q] = np.maximum(self.bound[q], kth(s, self.k))
            i, j = np.nonzero((s >= self.bound[q][:, None]) & (s > LEAST))
            self._keep(q[i], s[i, j], ids[j], rid[j])

    def _keep(self, *new: np.ndarray) -> None:
        q, s, ids, rid = (np.concatenate(x) for x in zip(self.found, new, strict=True))
        order = np.lexsort((rid, ids, -s, q))
        q, s, ids, rid = q[order], s[order], ids[order], rid[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(self.bound[q[last]], s[last])
        keep = place < self.k
        self.found = [q[keep], s[keep], ids[keep], rid[keep]]

    def batch(self) -> pa.RecordBatch:
        q, s, ids, rid = self.found
        return pa.RecordBatch.from_arrays([*map(pa.array, (self.rid[q], self.ids[q], s, ids, rid))], ["qrid", "query_id", "score", "key", "rid"])


UNIT = ["d", "unit", "piece"]


def top_products(vecs: DataFrame, is_query: Column, k: int = 20, factor: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vecs`` (vec_id, embedding) that ``is_query`` (over vec_id) holds for, the k rows with the highest inner product of
    the vectors floor(factor * x), from all rows but the query's own, ties to the smaller vec_id; all of them where there are fewer.

    Vectors that are null or hold null or non-finite components, or an integer component beyond 2^25, take no part. Only vectors of equal length are compared (empty
    ones with a score of 0). A repeated row is a row of its own: it is a candidate for its twin, and a repeated query is answered as often as it
    occurs. Rows with a null id are no queries and come last among ties. No queries or vectors: no rows. The result is exact.

    Every row is indexed; the pivots come from a sample of SAMPLE rows, which bears on speed only. A task of the search gets QUERIES queries and about VECTORS vectors of
    rings in reach of one of them. The driver gets the pivots, the largest norm and the number of queries of each partition.
    """
    spark = vecs.sparkSession
    rows = integer_vectors(vecs, factor).withColumn("query", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("key", F.coalesce("vec_id", F.lit(NO_ID))), "integers")
    top = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0)
    pivots = spark.sparkContext.broadcast(_pivots(rows, top))
    index = _index(rows, pivots, top, k)
    queries, before, offsets = index.where("query"), 0, []
    for part, n in sorted(map(tuple, queries.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "part int, before long")
    queries = queries.join(F.broadcast(offsets), "part").withColumn("unit", F.floor((F.col("before") + F.col("nth")) / QUERIES))
    rings = index.groupBy("d", "pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n"))
    pairs = rings.join(_reach(queries, pivots, top), ["d", "pivot"]).where("lo <= b and hi >= a")
    pairs = written(pairs.select("d", "unit", "ring", "n", F.greatest(F.col("a") - F.col("hi"), F.col("lo") - F.col("b")).alias("away")), "reach")
    pieces = pairs.groupBy("d", "unit").agg(F.ceil(F.sum("n") / VECTORS).cast("int").alias("pieces"))
    pairs = pairs.join(pieces, ["d", "unit"]).select("unit", "ring", "away", F.pmod(F.xxhash64("ring"), F.col("pieces")).cast("int").alias("piece"))
    asked = queries.join(pieces, ["d", "unit"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cols = ["rid", "key", "v", "pivot", "dist", "ring", "kth"]
    asked = asked.select(*UNIT, F.lit(0).alias("side"), F.lit(0.0).alias("away"), *[F.lit(-1).cast("long").alias(c) if c == "ring" else c for c in cols])
    tasks = index.join(pairs, "ring").select(*UNIT, F.lit(1).alias("side"), "away", *cols).unionByName(asked)
    order = [*UNIT, "side", "away", "ring"]

    def search(batches):
        best = None
        for c, bounds in runs(batches, order):
            for i, j in bounds:
                at = slice(i, j)
                if c["side"][i] == 0:
                    if best is not None:
                        yield best.batch()
                    best = _Best(c, at, _centres(pivots.value, int(c["d"][i])), top, k)
                else:
                    best.ring(c, at)
        if best is not None:
            yield best.batch()

    found = tasks.repartition(*UNIT).sortWithinPartitions(*order).mapInArrow(search, "qrid long, query_id long, score long, key long, rid long")
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), "key", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("key", F.lit(NO_ID)).alias("vec_id"), "score")


def oracle() -> str:
    """All products of the queries with all rows, for DuckDB."""
    return """WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM w q JOIN w c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20"""
