"""Importance resampling towards a target: hashed word n-grams of all documents against those of the target texts, drawn by perturbed scores.

A task takes its texts slice by slice and numbers the words of a slice. A suffix array over these numbers, sorted as deep as the longest n-gram,
puts equal n-grams next to each other, and the common prefixes of neighbours (LCP) tell where a run of equal n-grams of any
length ends. Each run is hashed once and its bucket written back to all its occurrences, which are then counted or scored in place.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTIAL, partial_sums, summed, written

#: Words of an n-gram at most; buckets; bytes of text in a slice.
WORDS, BUCKETS, SLICE = 2, 10_000, 1 << 20
#: Lower-cases A-Z and turns every other ASCII byte that is in no word into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def segments(texts: list, depth: int = WORDS, size: int = SLICE):
    """(position, words, repeated) in order: a text's words in pieces of about ``size`` bytes; a piece starts with the last ``depth`` - 1 words before it, of which there are ``repeated``."""
    for n, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        at, carry = 0, []
        while at < len(data):
            stop = data.find(b" ", at + size) if at + size < len(data) else -1
            stop = len(data) if stop < 0 else stop
            words = data[at:stop].split()
            if words:
                yield n, carry + words, len(carry)
                carry = (carry + words)[len(carry) + len(words) - depth + 1 :] if depth > 1 and len(carry) + len(words) >= depth - 1 else carry + words if depth > 1 else []
            at = stop


def slices(texts: list, depth: int = WORDS, size: int = SLICE):
    """Lists of segments that hold about ``size`` bytes together."""
    held, n = [], 0
    for s in segments(texts, depth, size):
        held.append(s)
        n += sum(map(len, s[1]))
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before) of numbers from 0 up, suffixes compared in their first ``depth`` places; the end counts as lowest."""
    n, top = len(ids), int(ids.max(initial=0)) + 2
    rank = ids.astype(np.int64)
    for k in range(1, depth):
        following = np.zeros(n, np.int64)
        following[: n - k] = ids[k:] + 1
        rank = rank * top + following
        if k + 1 < depth:
            rank = np.unique(rank, return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    lcp, equal = np.zeros(n, np.int64), np.ones(n, bool)
    equal[:1] = False
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < n) & (b < n)
        same = inside & (ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)])
        equal[1:] &= same
        lcp += equal
    return order, lcp


def buckets_of(held: list, depth: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, bucket) of every n-gram of up to ``depth`` words in the segments ``held``, repeats included."""
    words = [w for _, s, _ in held for w in s]
    coded = pa.array(words, pa.binary()).dictionary_encode()
    names, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(s) for _, s, _ in held])
    of = np.repeat(np.arange(len(held)), sizes)
    ids = np.zeros(len(words) + len(held), np.int64)  # 0 ends a segment
    place = np.arange(len(words)) + of
    ids[place] = number + 1
    segment = np.full(len(ids), -1)
    segment[place] = of
    inside = np.zeros(len(ids), np.int64)  # place in the segment
    inside[place] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text, repeated = np.array([n for n, _, _ in held]), np.array([r for _, _, r in held])
    order, lcp = suffixes(ids, depth)
    at_s, bucket_s = [], []
    for m in range(1, depth + 1):
        first = np.flatnonzero(lcp < m)  # each starts a run of suffixes that share m words
        start, length = order[first], np.diff(np.append(first, len(order)))
        whole = (segment[start] >= 0) & (start + m <= len(ids))
        whole[whole] = segment[start[whole] + m - 1] == segment[start[whole]]
        grams = [[names[i - 1] for i in ids[start[whole] + k].tolist()] for k in range(m)]
        hashes = np.zeros(len(first), np.int64)
        hashes[whole] = [zlib.crc32(b" ".join(g)) % buckets for g in zip(*grams, strict=True)]
        spread, fits = np.repeat(hashes, length), np.repeat(whole, length)
        at, bucket = order[fits], spread[fits]
        new = inside[at] + m > repeated[segment[at]]  # the others were counted with the piece before
        at_s.append(text[segment[at[new]]])
        bucket_s.append(bucket[new])
    return np.concatenate(at_s), np.concatenate(bucket_s)


def bucket_counts(texts: DataFrame, depth: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How often the n-grams of all rows of ``texts`` (text) fall into each bucket."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for held in slices(b.column(0).to_pylist(), depth):
                sums += np.bincount(buckets_of(held, depth, buckets)[1], minlength=buckets)
        if sums.any():
            yield from partial_sums(sums)

    return summed(texts.select(F.col("text").cast("string")).mapInArrow(count, PARTIAL), buckets)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) for each of the n buckets, s and t its counts, S and T their sums."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, depth: int = WORDS) -> DataFrame:
    """(doc_id, n_features, weight): the number of n-grams of each document and the floored mean of their buckets' gains (no n-grams: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches):
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for held in slices(b.column(1).to_pylist(), depth):
                of, bucket = buckets_of(held, depth, len(shared.value))
                n += np.bincount(of, minlength=b.num_rows)
                sums = np.concatenate([[0], np.cumsum(shared.value[bucket[order := np.argsort(of, kind="stable")]])])
                some, first = np.unique(of[order], return_index=True)
                total[some] += np.diff(sums[np.append(first, len(of))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(weigh, "doc_id long, n_features long, weight long")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the total order: sorted into ranges, numbered in each, and moved on by the rows of the ranges before. The driver gets
    one count for each range."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int, nth long"

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            cols = [pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "part", "nth"])

    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "ordered")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return rows.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = 25, least_words: int = 20, depth: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text): ``rank`` 1, 2, 3... for the drawn ones, null for the others.

    Features are the runs of 1 to ``depth`` words, each in one of ``buckets`` buckets; ``weight`` is the floored mean gain, ``score`` the weight plus Gumbel noise from a hash of
    the seed and the id, so that taking the highest scores draws without replacement in proportion to exp(weight / 1000). Of the N documents with
    ``least_words`` words or more, floor(``percent`` N / 100) are drawn, ties to the smaller id.

    A null text has no words. A null id is hashed as an empty one and comes last among ties; rows with equal ids are rows of their own, ordered by features and
    weight, equal ones in any order, as their results differ in rank only. Empty ``docs``: no rows; empty ``target``: all its counts are 0. Texts of any length
    are read whole, in pieces of SLICE bytes. Texts are read twice, and only numbers are shuffled.
    """
    gain = gains(bucket_counts(docs, depth, buckets), bucket_counts(target, depth, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weights(docs, gain, depth).withColumn("score", F.col("weight") + noise)
    # n words have n + (n - 1) + ... n-grams
    least = sum(max(least_words - k, 0) for k in range(depth))
    rows = written(rows.withColumn("short", (F.col("n_features") < least) if least else F.lit(False)), "scored")
    quota = percent * rows.where("not short").count() // 100
    order = [F.col("short"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    rank = F.when(~F.col("short") & (F.col("place") < quota), F.col("place") + 1)
    return _numbered(rows, order).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def oracle() -> str:
    """The same with lists of words, for DuckDB: the checksum is folded over the bytes with a table made by its rule."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    byte = "list_transform(range(1, len(h) // 2 + 1), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1)"
    return f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
    fd AS MATERIALIZED (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
    fb AS MATERIALIZED (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
    n AS MATERIALIZED (SELECT f, hex(f) AS h, any_value(t) AS t FROM (SELECT f FROM fd UNION SELECT f FROM fb), tab GROUP BY f),
    c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS k FROM n),
    s AS (SELECT k, count(*) AS s FROM fd JOIN c USING (f) GROUP BY k), t AS (SELECT k, count(*) AS t FROM fb JOIN c USING (f) GROUP BY k),
    g AS MATERIALIZED (SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s)::DOUBLE FROM s) + {BUCKETS}) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t)::DOUBLE FROM t), 0) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
    w AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM fd JOIN c USING (f) JOIN g USING (k) GROUP BY r),
    x AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight, len(w) >= 20 AS enough,
          CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
    y AS (SELECT doc_id, n_features, weight, enough, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) OVER (PARTITION BY enough) AS total FROM y)
    SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 25 * total // 100 THEN place END AS rank FROM z"""
