"""Codes of vectors by product quantisation in whole numbers: partial-distance search over codebooks that a fixed number of rounds refines.

A vector is cut into parts, and each part is written as the index of the nearest entry of that part's codebook. The search adds up squared
differences a few dimensions at a time, those with the largest variance among the entries first. The entry nearest so far is completed,
which gives a best complete distance; masks then drop every entry whose sum so far strictly exceeds it, so later dimensions
are looked at for few entries. An entry with the same distance is kept, so that the lowest index wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTIAL, integer_vectors, matrices, packed, partial_sums, summed, written

#: Parts, entries of a codebook, rounds, factor of the components; dimensions added between two tests; copies of a label's sum for the join back.
PARTS, ENTRIES, ROUNDS, FACTOR, STEP, SALTS = 4, 256, 4, 1024, 4, 8


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry of ``book`` nearest to each row of ``x``, ties to the lower index. Both hold 64-bit integers."""
    n, d = x.shape
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    cut = min(STEP, d)
    sums = np.zeros((n, len(book)), np.int64)
    for k in range(cut):
        sums += (x[:, k, None] - book[None, :, k]) ** 2
    guess = sums.argmin(axis=1)
    best = ((x - book[guess]) ** 2).sum(axis=1)
    i, j = np.nonzero(sums <= best[:, None])
    part = sums[i, j]
    while cut < d:
        stop = min(cut + STEP, d)
        part = part + ((x[i, cut:stop] - book[j, cut:stop]) ** 2).sum(axis=1)
        cut = stop
        keep = part <= best[i]
        i, j, part = i[keep], j[keep], part[keep]
        if cut < d and len(i) > 2 * n:  # complete the entry that leads now: a smaller bound for the dimensions to come
            first = np.lexsort((j, part, i))
            lead = first[np.concatenate([[True], i[first][1:] != i[first][:-1]])]
            best[i[lead]] = np.minimum(best[i[lead]], ((x[i[lead]] - book[j[lead]]) ** 2).sum(axis=1))
            keep = part <= best[i]
            i, j, part = i[keep], j[keep], part[keep]
    first = np.lexsort((j, part, i))
    lead = first[np.concatenate([[True], i[first][1:] != i[first][:-1]])] if n else first
    return j[lead], part[lead]


def _start(rows: DataFrame, entries: int, parts: int, width: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids. Reads ``entries`` rows at most."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].to_pylist()
    x = np.array(first, np.float64).reshape(len(first), -1).astype(np.int64)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1])))
    return np.ascontiguousarray(x.reshape(len(first), parts, width).transpose(1, 0, 2))


def compress(vecs: DataFrame, factor: int = FACTOR, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): rows (vec_id, label, code, error) for every vector kept of ``vecs`` (vec_id, embedding, label); codebooks parts x entries x width.

    Components become floor(factor * x). Each codebook starts as that part of the ``entries`` vectors with the smallest ids; a round assigns all parts and
    replaces each entry by the floored mean of its parts, entries without a part stay; then all are assigned once more. ``code`` is the list of indices in hex,
    two digits each, ``error`` the squared distances over all parts. Everything is in whole numbers, so the result does not depend on partitions.

    Vectors that are null or hold null or non-finite components, or an integer component beyond 2^25, are dropped. Codebooks belong to the length that most
    vectors have (ties: the shorter); vectors of another length are kept with a null code and error. A length that does not divide evenly is filled up with zeros.
    Fewer vectors than entries give fewer entries. Rows with equal ids are ordered by their vectors, null ids come last; repeated rows count each.
    No vectors: no rows, empty codebooks. Each round reads all vectors once; tasks add up their parts, and SPREAD sums of the codebooks' size
    reach the driver. Only the codebooks are broadcast.
    """
    spark = vecs.sparkSession
    rows = integer_vectors(vecs, factor)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "vec_id long, label long, code string, error long"
    if not sizes:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    d = sizes[0]["d"]
    width = -(-d // parts)
    books = _start(rows.where(F.size("v") == d), entries, parts, width)

    def pack(batches):
        for b in batches:
            cells = np.full(b.num_rows, None, object)
            for at, x in matrices(b.column(2)):
                if x.shape[1] == d:
                    cells[at] = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.tolist(), pa.binary())], ["vec_id", "label", "v"])

    rows = written(rows.select("vec_id", "label", "v").mapInArrow(pack, "vec_id long, label long, v binary"), "packed")
    good = rows.where("v is not null")

    def pieces(cells, book):
        """(part, its rows, nearest entries, distances) of a batch."""
        x = np.pad(packed(cells, d).astype(np.int64), ((0, 0), (0, parts * width - d))).reshape(len(cells), parts, width)
        for p in range(parts):
            yield (p, x[:, p], *nearest(x[:, p], book[p]))

    for _ in range(rounds):
        shared, n = spark.sparkContext.broadcast(books), books.shape[1]

        def gather(batches, shared=shared, n=n):
            sums = np.zeros((parts, n, width + 1), np.int64)
            for b in batches:
                for p, x, at, _ in pieces(b.column(0), shared.value) if b.num_rows else ():
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    sums[p, used, 0] += np.bincount(at, minlength=n)[used]
                    if width:
                        sums[p, used, 1:] += np.add.reduceat(x[order], first, axis=0)
            if sums[:, :, 0].any():
                yield from partial_sums(sums)

        sums = summed(good.select("v").mapInArrow(gather, PARTIAL), parts * n * (width + 1)).reshape(parts, n, width + 1)
        count = sums[:, :, :1]
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
        shared.destroy()
    final = spark.sparkContext.broadcast(books)

    def encode(batches):
        for b in batches:
            if not b.num_rows:
                continue
            got = list(pieces(b.column(2), final.value))
            codes = np.stack([at for _, _, at, _ in got], axis=1)
            digits = max(2, len(f"{max(entries - 1, 0):x}"))
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            error = sum(dist for *_, dist in got)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = good.mapInArrow(encode, schema)
    other = rows.where("v is null").select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def fingerprint(books: np.ndarray) -> str:
    """Hex sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest_row(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with label_error, the errors of a label's vectors added up (null labels together), and the fingerprint of the codebooks. A label's sum is
    joined back in SALTS copies, so that a label with a third of all vectors is shared out."""
    coded = written(coded, "coded")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    x, y = salted.alias("x"), sums.alias("y")
    out = x.join(y, F.col("x.label").eqNullSafe(F.col("y.label")) & (F.col("x.s") == F.col("y.s")), "left")
    return out.select("x.vec_id", "x.code", "x.error", "y.label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """The same by joins of every part with every entry, round by round, for DuckDB."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS x FROM k, range({PARTS}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES})",
    ]
    far = "list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, x, d.e AS e, d.far AS far FROM (SELECT p.r, p.p, any_value(p.x) AS x, min(struct_pack(far := CAST({far} AS BIGINT), e := b.e)) AS d FROM p JOIN b{i} b ON p.p = b.p GROUP BY p.r, p.p))")
        if i < ROUNDS:
            steps.append(f"m{i} AS MATERIALIZED (SELECT p, e, list(c ORDER BY i) AS c FROM (SELECT p, e, i, (sum(c) - ((sum(c) % count(c)) + count(c)) % count(c)) // count(c) AS c FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    steps.append(f"f AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    return f"WITH {', '.join(steps)} SELECT k.vec_id, lower(f.code) AS code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN f USING (r), h"
