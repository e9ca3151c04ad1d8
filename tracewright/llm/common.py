"""What several operators share: written tables in the shared folder, connected components, labelled samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of intermediate tables that this process has made.
_MADE: list[str] = []


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracewright-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Only a session whose master is local, which runs in one process, may leave that unset: it gets a
    folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    _MADE.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables of this process and say how many; to be called once no result that reads them is needed any more."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back. Lost executors cost nothing."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Where the session leaves Arrow batches at Spark's 10,000 rows, they are set to 1,000: whole texts are long, and a task holds a batch on both sides."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def min_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (i, j): the smallest node reachable from each."""
    lab = np.arange(n)
    while len(i):
        a, b = lab[i], lab[j]
        low = np.minimum(a, b)
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
        apart = lab[i] != lab[j]
        i, j = i[apart], j[apart]
    return lab


def runs(batches, keys):
    """(columns, bounds) of whole runs of rows with equal ``keys`` in sorted batches. Parts of a run that is not finished are kept apart and joined once."""
    held: list[dict] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(b.schema.names)}
        new = np.zeros(b.num_rows, bool)
        new[0] = bool(held) and any(c[k][0] != held[-1][k][-1] for k in keys)
        for k in keys:
            new[1:] |= c[k][1:] != c[k][:-1]
        at = np.flatnonzero(new)
        if not len(at):
            held.append(c)
            continue
        off = sum(len(h[keys[0]]) for h in held)
        done = [*held, {k: v[: at[-1]] for k, v in c.items()}]
        stops = (at + off).tolist()
        yield {k: np.concatenate([x[k] for x in done]) for k in c}, [(i, j) for i, j in zip([0, *stops], stops, strict=False) if j > i]
        held = [{k: v[at[-1] :] for k, v in c.items()}]
    if held:
        whole = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        yield whole, [(0, len(whole[keys[0]]))]


def _forest(batches):
    """Replace the links of one partition by a spanning forest of stars: what leaves a task is linear in its nodes."""
    us, vs = [], []
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        lab = min_labels(len(nodes), at[: len(u)], at[len(u) :])
        own = lab != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[lab[own]], pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of ``links``: one row (node, component) per linked node, component = smallest node reachable.

    Each round lets every node take its smallest neighbour, jumps the pointers once and rewrites the links between
    the surviving representatives; a round at least halves what can still merge, whatever the degree of a node. Only joins
    and pre-aggregated minima are used, so a hub with millions of links is split like any other skewed join key.
    Null ends and self links link nothing. No links: no rows.
    """
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = written(e.mapInArrow(_forest, "u long, v long"), "links")
    labels = e.sparkSession.createDataFrame([], "node long, component long")
    first = True
    while not e.isEmpty():
        both = e.union(e.select("v", "u"))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        x, y = up.alias("x"), up.alias("y")
        up = written(x.join(y, F.col("x.p") == F.col("y.u")).select("x.u", F.col("y.p").alias("p")), "parents")
        if first:
            labels, first = up.select(F.col("u").alias("node"), F.col("p").alias("component")), False
        else:
            labels = labels.join(up, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component"))
        pu, pv = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = e.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v"))
        e = written(e.mapInArrow(_forest, "u long, v long"), "links")
    return labels


def labelled_ids(labels: DataFrame, label: str, keep, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each class 0/1 with (doc_id, y), taken in the order of a hash of the id.

    ``keep`` is the condition of the training fold. The result has at most 2 x per_class rows, so it may be broadcast.
    Several labels of one document count as their largest.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("y"))
    pick = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
    return pick(1).union(pick(0)).select("doc_id", F.col("y").cast("int").alias("y"))


def fold(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def with_columns(b: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added or, where the name is taken, replaced."""
    cols = {n: c for n, c in zip(b.schema.names, b.columns, strict=True)} | new
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


#: Integer components further from zero take no part: products and squared distances of 2,048 of them still fit a long.
LARGEST = 1 << 25
#: Copies of a sum that reach the driver, and bytes of one row of a partial sum.
SPREAD, SUM_BYTES = 16, 1 << 14


def integer_vectors(vecs: DataFrame, factor: int) -> DataFrame:
    """The columns ``vec_id`` (long), ``label`` where there is one, and ``v``: floor(factor * x) of each component x of ``embedding``, as doubles.

    Vectors that are null or hold null or non-finite components go, and those with an integer component beyond LARGEST, whose products a long cannot hold.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(float(factor)) * x).cast("double"))
    bad = f"embedding is null or exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity') or abs(double(x)) * {factor} > {LARGEST})"
    label = [F.col("label").cast("long").alias("label")] if "label" in vecs.columns else []
    return vecs.where(~F.coalesce(F.expr(bad), F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), *label, whole.alias("v"))


def packed(cells: pa.Array, d: int) -> np.ndarray:
    """The matrix of a column of packed 32-bit vectors, one row each."""
    return np.frombuffer(b"".join(cells if isinstance(cells, np.ndarray) else cells.to_pylist()), "<i4").reshape(len(cells), d)


def matrices(column: pa.Array):
    """(positions, matrix of doubles) for each length among the lists of ``column``."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, flat[start[at][:, None] + np.arange(d)].reshape(len(at), int(d))


def partial_sums(sums: np.ndarray):
    """Rows (key, task, sums) of one task for ``summed``: its array of 64-bit sums in pieces of bounded size."""
    task, flat, step = TaskContext.get().partitionId(), np.ascontiguousarray(sums, "<i8").ravel(), SUM_BYTES // 8
    keys = range(-(-len(flat) // step))
    for k in keys:
        cells = [pa.array([k], pa.int32()), pa.array([task % SPREAD], pa.int32()), pa.array([flat[k * step : (k + 1) * step].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["key", "task", "sums"])


PARTIAL = "key int, task int, sums binary"


def summed(parts: DataFrame, length: int) -> np.ndarray:
    """The sum of the arrays, ``length`` long, that tasks gave as ``partial_sums``. Pieces are added in SPREAD tasks for each key first, so the driver gets
    SPREAD arrays at most, whatever the number of tasks."""

    def add(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(s, "<i8")
                got[k] = got[k] + x if k in got else x
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([0] * len(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], ["key", "task", "sums"])

    out = np.zeros(length, np.int64)
    rows = parts.repartition(SPREAD, "key", "task").mapInArrow(add, PARTIAL).toArrow()
    for k, s in zip(rows["key"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        x = np.frombuffer(s, "<i8")
        out[k * (SUM_BYTES // 8) :][: len(x)] += x
    return out
