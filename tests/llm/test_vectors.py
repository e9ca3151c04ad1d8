"""Top-k search, importance resampling and vector codes against plain computations, and their odd cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import codes, common, nearest, resampling

VECS = "vec_id long, embedding array<float>, label int, rid string, key int, d int, v string"
DOCS = "doc_id long, text string, score string, place int, part int, n_features string"


def vec_rows(n=400, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[1::7] = x[0]  # one vector makes up a seventh
    return [(i, [float(c) for c in v], i % 5, "r", 1, 2, "v") for i, v in enumerate(x)]


ODD = [(400, None, 1), (401, [], 2), (402, [1.0, None] * 4, 0), (403, [float("nan")] * 8, 0), (404, [float("inf")] * 8, 0), (None, [0.5] * 8, 3), (20, [0.25] * 8, None), (20, [0.25] * 8, None), (405, [1.0, 2.0, 3.0], 1), (420, [1.0, 1.0, 1.0], 1), (440, [3e30] + [0.0] * 7, 1), (460, [0.0] * 8, 1)]


def frame(spark, rows):
    return spark.createDataFrame([r if len(r) == 7 else (*r, "r", 1, 2, "v") for r in rows], VECS)


def kept(rows, factor):
    out = []
    for r in rows:
        v = r[1]
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            whole = [math.floor(factor * float(np.float32(c))) for c in v]
            if all(abs(c) <= common.LARGEST for c in whole):
                out.append((r[0], whole, r[2]))
    return out


def best(rows, k, factor):
    got = []
    use = kept(rows, factor)
    for i, (q, x, _) in enumerate(use):
        if q is None or q % 20:
            continue
        s = [(-sum(a * b for a, b in zip(x, y, strict=True)), c is None, c or 0, c) for j, (c, y, _) in enumerate(use) if j != i and len(y) == len(x)]
        got += [(q, r, c, -p) for r, (p, _, _, c) in enumerate(sorted(s, key=lambda t: t[:3])[:k], 1)]
    return sorted(got, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_top_products_equal_brute_force(spark, monkeypatch, small):
    if small:  # several rings, units and pieces
        for name, n in (("RING", 16), ("QUERIES", 7), ("VECTORS", 60), ("ROWS", 4), ("PIVOTS", 5)):
            monkeypatch.setattr(nearest, name, n)
    rows = vec_rows() + ODD
    df = frame(spark, rows).repartition(5)
    got = nearest.top_products(df, F.col("vec_id") % 20 == 0, 20, 64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == best(rows, 20, 64)


def test_top_products_of_little(spark):
    ask = F.col("vec_id") % 20 == 0
    assert nearest.top_products(frame(spark, []), ask).count() == 0
    assert nearest.top_products(frame(spark, [(0, [1.0], 1)]), ask).count() == 0
    assert nearest.top_products(frame(spark, [(1, [1.0], 1), (2, [1.0], 1)]), ask).count() == 0
    two = nearest.top_products(frame(spark, [(0, [1.0], 1), (0, [1.0], 1)]), ask)
    assert [tuple(r) for r in two.collect()] == [(0, 1, 0, 4096)] * 2


def test_rings_far_away_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(nearest, "RING", 32)
    monkeypatch.setattr(nearest, "PIVOTS", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 10
    rows = [(i, [float(c) for c in centres[i % 8] + rng.normal(size=6) * 0.01], 0) for i in range(1600)]
    df = frame(spark, rows)
    whole = common.integer_vectors(df, 64).withColumn("query", F.col("vec_id") % 20 == 0).withColumn("rid", F.monotonically_increasing_id()).withColumn("key", F.col("vec_id"))
    whole = common.written(whole, "test")
    top = float(whole.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    pivots = spark.sparkContext.broadcast(nearest._pivots(whole, top))
    index = nearest._index(whole, pivots, top, 20)
    near = nearest._reach(index.where("query and pivot = 0").withColumn("unit", F.lit(0).cast("long")), pivots, top)
    rings = index.groupBy("d", "pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    assert rings.join(near, ["d", "pivot"]).where("lo <= b and hi >= a").count() < rings.count() / 2
    assert sorted(map(tuple, nearest.top_products(df, F.col("vec_id") % 20 == 0).collect()), key=repr) == best(rows, 20, 64)


def test_partial_distance_search_finds_the_first_nearest():
    rng = np.random.default_rng(0)
    for n, e, d, top in ((50, 16, 16, 3), (20, 256, 7, 50), (5, 1, 4, 9), (9, 4, 0, 1), (30, 12, 33, 2)):
        x, book = rng.integers(-top, top, (n, d)), rng.integers(-top, top, (e, d))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, dist = codes.nearest(x.astype(np.int64), book.astype(np.int64))
        assert (at == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()


def plain_codes(rows):
    use = sorted((r for r in kept(rows, 1024) if len(r[1]) == 8), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = lambda v: [v[2 * p : 2 * p + 2] for p in range(4)]
    books = [[list(parts(v)[p]) for _, v, _ in use[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(4):
        new = []
        for p in range(4):
            at = [near(parts(v)[p], books[p])[1] for _, v, _ in use]
            new.append([[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [parts(v)[p] for (_, v, _), a in zip(use, at, strict=True) if a == e]) else old for e, old in enumerate(books[p])])
        books = new
    found = [(i, [near(x, books[p]) for p, x in enumerate(parts(v))], lab) for i, v, lab in use]
    errors = {}
    for _, f, lab in found:
        errors[lab] = errors.get(lab, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[lab], digest) for i, f, lab in found], key=repr)


def test_codes_equal_plain_rounds(spark):
    rows = vec_rows(330) + ODD
    got = codes.digest_row(*codes.compress(frame(spark, rows).repartition(4)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows_of = [tuple(r) for r in got.collect()]
    assert sorted((r for r in rows_of if r[1] is not None), key=repr) == plain_codes(rows)
    assert {r[0] for r in rows_of if r[1] is None} == {401, 405, 420}  # another length


def test_codes_of_little(spark):
    none, books = codes.compress(frame(spark, []))
    assert none.count() == 0 and books.size == 0 and codes.digest_row(none, books).count() == 0
    few = codes.digest_row(*codes.compress(frame(spark, [(5, [1.0] * 6, None), (5, [1.0] * 6, None), (3, [0.0] * 6, 1)])))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in few.collect()) == [(3, "00000000", 0, 0), (5, "01010100", 0, 0), (5, "01010100", 0, 0)]  # the last part is all filling


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, depth=2):
    w = words_of(text)
    return [" ".join(w[i : i + m]) for m in range(1, depth + 1) for i in range(len(w) - m + 1)]


def plain_resample(docs, target, depth=2):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in docs:
        for g in grams(x, depth):
            s[bucket(g)] += 1
    for x in target:
        for g in grams(x, depth):
            t[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in docs:
        g = [gain[bucket(f)] for f in grams(x, depth)]
        w = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x)) >= 20])
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): k for k, r in enumerate(ranked[: 25 * len(ranked) // 100], 1)}
    return sorted([(*r[:4], place.get(id(r))) for r in out], key=repr)


def texts(n=120):
    rng = np.random.default_rng(5)
    vocabulary = ["Straße", "naïve", "the", "The", "a1", "x_y", "日本", "it's", " gap", "İx", "end.\x00nul", "ab", "cd"]
    return [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("size", "depth"), [(1 << 20, 2), (40, 2), (7, 3), (1 << 20, 1)])
def test_features_equal_plain_ones(size, depth):
    data = [x for _, x in texts(30)] + [None, "", "one", "two words", "word " * 300, "unbroken" * 50]
    got = [[] for _ in data]
    for held in resampling.slices(data, depth, size):
        for at, b in zip(*resampling.buckets_of(held, depth), strict=True):
            got[at].append(int(b))
    assert [sorted(g) for g in got] == [sorted(zlib.crc32(g.encode()) % 10000 for g in grams(x, depth)) for x in data]


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for n, top, depth in ((50, 3, 2), (40, 2, 4), (1, 1, 2), (30, 1, 3)):
        ids = rng.integers(0, top, n)
        order, lcp = resampling.suffixes(ids, depth)
        cut = lambda i: tuple(ids[i : i + depth])
        assert [cut(i) for i in order] == sorted(cut(i) for i in range(n)) and sorted(order) == list(range(n))
        common_words = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert lcp.tolist() == [0, *(common_words(cut(a), cut(b)) for a, b in zip(order, order[1:], strict=False))]


def test_resample_equals_plain_one(spark):
    docs = texts() + [(7, "again"), (7, None), (None, "word " * 25), (None, ""), (200, "ab cd " * 4000), (201, "日" * 70000), (202, "ab " * 19), (203, "ab " * 20)] + [(300 + i, "the same twenty words " * 6) for i in range(40)]
    target = ["ab cd the", None, "naïve Straße"]
    df = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in docs], DOCS).repartition(6)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target)


def test_resample_of_little(spark):
    empty, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "word " * 30, "x", 1, 2, "y")], DOCS)
    assert resampling.resample(empty, one).count() == 0
    assert resampling.resample(one, empty).first()["rank"] is None
    assert resampling.resample(one, empty, percent=100).first()["rank"] == 1
