"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import bpe, common, embeddings, language, licences, media, mixing, pii, quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "A Plain Text, with words.", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "   \t\n ", "en", "", 6),
    (5, "A Plain Text, with words.", "en", "b", 5),
    (5, "A Plain Text, with words.", "en", "b", 5),
    (None, "no id <|endoftext|> here", "en", "b", 5),
    (7, "x" * 70_000, "en", "a", 70_000),
    (8, "äöü €uro \U0001f600 日本 " * 3000, "de", "c", 1),
    (9, "mail a.b@c.de_f@g.hi or 1.2.3.4 and 4111 1111 1111 1111, +1 (555) 010-9999!", "en", "c", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names operators use themselves."""
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("score", "fp", "node", "size", "u", "v", "spans", "base", "digest", "n", "copies", "component_id", "label", "terms", "of", "p_source", "p_size", "goal_source", "words", "rest", "entity", "c0", "c1", "several", "rank", "key", "weight", "taken", "i")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def find_components(n, pairs):
    up = list(range(n))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components_are_those_of_a_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 600)] + [(700, i) for i in range(701, 900)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long").repartition(7), "a", "b").collect()}
    want = find_components(1000, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert common.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b").count() == 0


def brute_fingerprint(text, shingle=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    items = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_simhash(rows, texts, radius=4):
    want_fp = [brute_fingerprint(t) for _, t in texts]
    ids = [i for i, _ in texts]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if ids[a] is not None and ids[b] is not None and (want_fp[a] ^ want_fp[b]).bit_count() <= radius]
    top = find_components(len(ids), pairs)
    least = {}
    for k, i in zip(top, ids, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is not None)
    assert got == sorted((i, f"{f:016x}", least[k]) for i, f, k in zip(ids, want_fp, top, strict=True) if i is not None)


def test_simhash_is_exact(spark, docs, odd, none):
    check_simhash(simhash.simhash_components(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    check_simhash(simhash.simhash_components(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert simhash.simhash_components(none).count() == 0
    kept = [r["doc_id"] for r in simhash.dedup(odd).collect()]
    assert kept.count(1) == 1 and 5 not in kept and 7 in kept and None in kept


def test_hamming_links_cover_all_pairs_in_large_buckets(spark):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 62, 4)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 7))) for c in center for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    fps = sorted(fps)
    links = simhash.hamming_links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp0 long, node long"), 4)
    got = {r["node"]: r["component"] for r in common.components(links, "u", "v").collect()}
    x = np.array(fps, np.uint64)
    pairs = [(i, int(j) + i + 1) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4)]
    assert [got.get(i, i) for i in range(len(fps))] == find_components(len(fps), pairs)
    assert all((r["u"] != r["v"]) for r in links.collect())


@pytest.mark.parametrize("n", [1000, 10**9])
def test_plan_finds_every_pair(n):
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    masks = simhash.plan(n, (bits.T @ bits) * (n / 500), 4)
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m[0] for m in masks)


def test_bpe_equals_the_library(spark, docs, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(registry.VOCABULARY)
    texts = [r["text"] for r in docs.collect()] + [r[1] for r in ODD] + ["'s's'LL it's İSTANBUL ΑΣ ½ ²³ १२ é a\x1cb\x85c <|startoftext|><|endoftext|>", "don't!!'re", "ab" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode(df, registry.VOCABULARY, decoded=True).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)
    short = {r["doc_id"]: r for r in bpe.encode(df, registry.VOCABULARY, with_ids=False).collect()}
    assert short[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, lib.encode(texts[0], add_special_tokens=False).ids)).encode()).hexdigest()
    assert bpe.encode(odd, registry.VOCABULARY).count() == len(ODD) and bpe.encode(none, registry.VOCABULARY).count() == 0


def accuracy(rows, truth):
    rows = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 20 and all(0 <= r["score"] <= 1 for r in rows)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows)


def test_classifiers_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    assert accuracy(registry.op3_quality(spark, sf).collect(), truth["quality"].to_dict()) > 0.93
    assert accuracy(registry.op7_toxicity(spark, sf).collect(), truth["toxic"].to_dict()) > 0.85


def test_classifiers_take_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (8, 0, 0), (3, 0, 0), (None, 1, 1), (5, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for m, kind in ((quality, "quality"), (toxicity, "toxic")):
        model = m.fit(odd, labels, F.lit(True), kind)
        got = m.score(odd, model).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1
        assert m.score(none, model).count() == 0
        assert len(m.score(odd, m.fit(odd, labels.limit(0), F.lit(True), kind)).collect()) == len(ODD)


def test_toxicity_tolerates_gaps_and_inserted_characters(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("theraonistu"), rng.integers(3, 8)))
    text = lambda: " ".join(word() for _ in range(12)) + ". "
    clean = [text() + text() for _ in range(300)]
    said = ["gormless", "nitwick", "blockhead", "gorm*less", "nit-wick", "bl ockhead", "b l o c k h e a d"]
    toxic = [text() + f"you {rng.choice(said)} " + text() for _ in range(200)]
    rows = [(i, t, int(i >= len(clean))) for i, t in enumerate(clean + toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    low, *high = m.score(["", "you gormless", "you gor-mless", "n i t w i c k", "blocxkhead!", "nitwwick"])
    assert low < 0.5 and min(high) > 0.5


def brute_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_pii_base_spans(spark, docs, odd, none):
    hard = ["a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "001.255.0.256 0255.1.1.1 999999999999.1.1.1", "\U0001f600 x@y.zz", "+1+1 (555) 010-9999+", "4111-1111-1111-1111 5500 0000 0000 0004 12345678901234", "9" * 5000, "a." * 3000 + "@", "1" * 3000 + "." + "2" * 3000, "%@a.b a@.b @", "+1 555 010 9999 ext", "+123456789 0..", "1 2-3 4-5 6-7 8-9 0-1 2-3 4 5 6 7 8 9"]
    rng = np.random.default_rng(4)
    hard += ["".join(rng.choice(list("ab1234567890.@+-() é"), 60)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string").select("doc_id", "text", pii.base_spans(F.col("text")).alias("b"))
    for r in df.collect():
        assert [(x["s"], x["e"], x["kind"]) for x in r["b"]] == brute_pii(r["text"]), r["text"][:80]
    got = pii.digest_row(pii.sanitised(odd)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[9]["spans"].startswith("email:5:13,email:13:20,") and by[9]["n_card"] == by[9]["n_ip"] == by[9]["n_phone"] == 1
    assert by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.digest_row(pii.sanitised(none)).count() == 0
    for r in pii.digest_row(pii.sanitised(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in brute_pii(r["text"])).encode()).hexdigest()


def test_pii_terms_that_disclose_a_value(spark):
    texts = [f"filler{i} word. write to zoltan quux at zq@mail.example or call, thing {i}" for i in range(6)] + [f"the word at thing or to call {i} and write" for i in range(300)] + ["zoltan alone stays"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.sanitised(df, alpha=0.6).select("*", pii.redacted(F.col("text"), F.col("spans")).alias("new")).collect()}
    found = {x["value"] for x in rows[0]["spans"] if x["kind"] == "term"}
    assert "quux" in found and "zoltan" in found and not found & {"word", "at", "call", "thing", "filler0"}
    assert "[EMAIL]" in rows[0]["new"] and "quux" not in rows[0]["new"] and "[TERM]" in rows[0]["new"]
    assert rows[306]["new"] == "[TERM] alone stays"  # six different texts hold it with the value


def test_pii_terms_of_rare_values_anywhere_in_a_text(spark):
    far = "common words of all kinds " * 20
    texts = ["Quux, first. " + far + "write to ab@c.example. " + far + "then QUUX\u0130 and quux again", "quux once; cd@e.example and ef@g.example", "cd@e.example again", "two zabble ij@k.example", "two zabble ij@k.example", "no value quux"] + [far] * 4000
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.sanitised(df).where("doc_id < 6").collect()}
    got = {i: [r["text"][x["s"] : x["e"]] for x in r["spans"] if x["kind"] == "term"] for i, r in rows.items()}
    assert got == {0: ["first", "write", "to", "then", "QUUX\u0130"], 1: ["once"], 2: [], 3: ["two", "zabble"], 4: ["two", "zabble"], 5: []}
    rows = pii.sanitised(df.where("doc_id <> 5"), alpha=0.8).where("doc_id < 2").collect()
    got = {r["doc_id"]: [r["text"][x["s"] : x["e"]] for x in r["spans"] if x["kind"] == "term"] for r in rows}
    assert got[0].count("quux") == 1 and got[0].count("Quux") == 1 and "quux" in got[1]


def brute_targets(words):
    w = [(3, 1, 2)[i % 3] for i in range(len(words))]
    out, free, budget = [0.0] * len(words), set(range(len(words))), 1.5 * sum(words)
    while free:
        level = (budget - sum(out[i] for i in range(len(words)) if i not in free)) / sum(w[i] for i in free)
        over = {i for i in free if level * w[i] > 2 * words[i]}
        for i in free:
            out[i] = 2 * words[i] if i in over else level * w[i]
        free -= over
        if not over:
            break
    return out


def check_mix(rows, texts):
    df = pd.DataFrame([r.asDict() for r in rows])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in rows) == sorted((-1 if i is None else i, count(t)) for i, t, _ in texts)
    sources = sorted({s for _, _, s in texts}, key=lambda s: (s is None, s or ""))
    words = [sum(count(t) for _, t, s in texts if s == x) for x in sources]
    for x, w, want in zip(sources, words, brute_targets(words), strict=True):
        part = df[df["source"].isna()] if x is None else df[df["source"] == x]
        assert (part["source_size"] == w).all() and np.allclose(part["target"], want)
        assert abs(part["taken"].sum() - want) <= max(1, 0.02 * want if len(part) > 8 else part["size"].max()), (x, want, part["taken"].sum())
    assert (df["taken"] <= 2 * df["size"]).all() and (df["taken"] % df["size"].clip(lower=1) == 0).all()


def test_mixing(spark, docs, odd, none):
    cols = ["doc_id", "source", "text"]
    first = mixing.mix(docs.select(cols)).collect()
    check_mix(first, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    again = mixing.mix(docs.select(cols).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in first) == sorted((r["doc_id"], r["taken"]) for r in again)
    check_mix(mixing.mix(odd).collect(), [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.mix(none).count() == 0
    hot = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"), F.when(F.col("id") < 4000, "one two three").otherwise(F.repeat(F.lit("w "), (F.col("id") % 17).cast("int"))).alias("text"))
    check_mix(mixing.mix(hot).collect(), [(r["doc_id"], r["text"], r["source"]) for r in hot.collect()])
    rows = mixing.mixed(docs).groupBy("doc_id").count().collect()
    took = {r["doc_id"]: r["copies"] for r in first if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in rows} == took and mixing.mixed(docs).columns == docs.columns


def test_budget_fitting_is_exact_where_sums_allow():
    rng = np.random.default_rng(6)
    for _ in range(50):
        length, count = np.unique(rng.integers(1, 40, 12)), None
        count = rng.integers(0, 9, len(length))
        budget = int(rng.integers(0, (length * count).sum() + 5))
        sums = {0}
        for a, c in zip(length.tolist(), count.tolist(), strict=True):
            sums = {s + a * k for s in sums for k in range(c + 1)}
        take = mixing.fit_counts(length, count, budget)
        assert (take <= count).all() and (take >= 0).all()
        assert abs(budget - (take * length).sum()) == min(abs(budget - s) for s in sums)


def test_media_round_trip(spark, docs, odd, none):
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (odd, [(r[0], r[1]) for r in ODD])):
        folder = media.store(df)
        got = media.features(media.load(spark, folder)).collect()
        want = []
        for i, t in rows:
            b = (t or "").encode()
            p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
            want.append((-1 if i is None else i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
        small = spark.read.format("tracewright_archive").option("rangeBytes", "3000").load(folder)
        assert small.count() == len(rows) and small.rdd.getNumPartitions() > 3
    assert media.features(media.load(spark, media.store(none))).count() == 0


def test_media_damage_stays_with_its_member(spark, docs):
    folder = media.store(docs.coalesce(1))
    path = folder.removeprefix("file://")
    import os

    name = next(f for f in os.listdir(path) if f.endswith(".zip"))
    data = bytearray(open(f"{path}/{name}", "rb").read())
    data[60] ^= 255
    open(f"{path}/{name}", "wb").write(data)
    rows = media.features(media.load(spark, folder)).collect()
    assert len(rows) == docs.count() and sum(r["error"] is not None for r in rows) == 1


def test_embedding_links_are_exact(spark, none):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(900):
        v = (base[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])).astype(np.float32).tolist()
        rows.append((i, v, int(i % 30 // 10)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, rows[1][1], None), (2004, [], 1), (2005, [1.0, None], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [float("inf")] * 16, 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])).withColumn("node", F.lit("x")).repartition(5)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    pairs, n = [], {r[0]: 0 for r in rows}
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                x, y = np.array(ok[a][1], float), np.array(ok[b][1], float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    pairs.append((a, b))
                    n[ok[a][0]] += 1
                    n[ok[b][0]] += 1
    top = find_components(len(ok), pairs)
    comp = {r[0]: r[0] for r in rows}
    least = {}
    for k, r in zip(top, ok, strict=True):
        least[k] = min(least.get(k, r[0]), r[0])
    comp |= {r[0]: least[k] for k, r in zip(top, ok, strict=True)}
    assert len(pairs) > 500
    for i in comp:
        assert (got[i]["n_links"], got[i]["component_id"]) == (n[i], comp[i]), i
        assert got[i]["kept"] == (i == comp[i])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_language(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = language.identify(pages).collect()
    assert len(got) == pages.count()
    assert sum(r["lang"] == r["declared"] for r in got) / len(got) > 0.95
    wrong = pages.withColumn("html", F.when(F.col("page_id") % 10 == 0, F.regexp_replace("html", 'lang="[a-z]+"', 'lang="en"')).otherwise(F.col("html")))
    again = {r["page_id"]: r["lang"] for r in language.identify(wrong).collect()}
    assert sum(again[r["page_id"]] == r["lang"] for r in got) / len(got) > 0.95  # the text outweighs a wrong declaration
    odd = spark.createDataFrame([(1, None, None), (2, "not a url", ""), (2, "http://h.example/x", "<p>text</p>"), (None, "http://a.b.example/", '<html lang="en">')], "page_id long, url string, html string").withColumn("host", F.lit(1))
    rows = language.identify(odd.unionByName(pages.withColumn("host", F.lit(1)))).collect()
    assert len(rows) == len(got) + 4 and all(r["lang"] for r in rows)
    assert all(r["lang"] is None for r in language.identify(odd.where("page_id < 3")).collect())
    assert language.identify(odd.limit(0)).count() == 0


def test_declared_language_lies_anywhere_in_the_page():
    tag = b'<html class="x" lang="fi-FI">'
    assert language.declared(b"<!-- " + b"licence " * 5000 + b'<html lang="en"> -->' + b" " * 5000 + tag) == "fi"
    assert language.declared(b"<html><script>'<html lang=en>'</script>" + tag) == "fi"
    assert language.declared(tag[:-1]) == "fi" and language.declared(b"<!-- " + tag) is None and language.declared(None) is None
    assert language.declared(b"<html " * 200_000 + b"<!--" * 200_000) is None


def test_a_rare_language_is_told_apart_in_a_large_corpus(spark):
    html = F.when(F.col("id") < 25, '<html lang="fi"><p>ja ei ole minun talo on suuri kaunis').when(F.col("id") < 35, '<html lang="xx">').otherwise('<html lang="en"><p>the house is not mine and it was large')
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".example/")).alias("url"), html.alias("html"))
    got = {r["page_id"]: r["lang"] for r in language.identify(pages).where("page_id < 100").collect()}
    assert all(got[i] == "fi" for i in range(25)) and all(got[i] == "en" for i in range(35, 100)) and "xx" not in got.values()


def test_licences(spark, odd, none):
    mit = "Copyright (c) 2020 Some One\n" + licences._MIT.replace("sublicense", "sub-licence").upper()
    wrapped = [re.sub(" (?=COPYRIGHT HOLDERS)", "\n", licences._MIT), licences._ISC.replace("above copyright", "above\ncopyright"), "Copyright 2019 A. Body\nAll rights reserved.\n" + "\n * ".join(dict(licences.KNOWN[2:3])["BSD-3-Clause"].split(" "))]
    texts = [mit, "  Licensed under the Apache License, version 2.0", "prose\nReleased under the MIT License.\nmore\nLicensed under CC BY-NC 4.0.", "licence of another kind", None, "", *wrapped, licences._UNLICENSE.lower()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licences.scan(df).collect()}
    assert got == {0: ("MIT", None), 1: ("Apache-2.0", "Apache-2.0"), 2: (None, "CC-BY-NC-4.0,MIT"), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("MIT", None), 7: ("ISC", None), 8: ("BSD-3-Clause", None), 9: ("Unlicense", None)}
    assert licences.scan(odd).count() == len(ODD) and licences.scan(none).count() == 0
    own = spark.createDataFrame([("X-1", "Licence of another  kind!"), (None, "x"), ("X-2", None)], "license string, text string")
    assert {r["license"] for r in licences.scan(df, known=own).collect()} == {None, "X-1"}
    assert {r["license"] for r in licences.scan(df, known=own.limit(0)).collect()} == {None}


def test_lines_of_any_known_text_are_found(spark):
    """Whole licences as one line of a longer text, also those without the word licence, in any of their spellings; a caller's table likewise."""
    isc, zlib = licences._ISC.replace("\n", " "), next(t for i, t in licences.KNOWN if i == "Zlib").replace("\n", " ")
    own = [("N-1", "Licence key holders only"), ("N-2", "Zutritt verboten"), ("N-3", "Copyright owner must agree"), ("N-4", "Sublicense it"), ("N-5", "free")]
    texts = [f"a\n{isc}\nb", f"{zlib}\nb", "x\n ** LICENSE, KEY holders only\n", "zutritt  VERBOTEN!\n-\nFree.", "y\nThe copyright", "sub-licence it\nz", "z\n1 Zutritt verboten"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r["doc_id"]: r["notices"] for r in licences.scan(df).collect()}
    assert {k: v for k, v in plain.items() if v} == {0: "ISC", 1: "Zlib"}
    got = {r["doc_id"]: r["notices"] for r in licences.scan(df, known=spark.createDataFrame(own, "license string, text string")).collect()}
    assert {k: v for k, v in got.items() if v} == {2: "N-1", 3: "N-2,N-5", 5: "N-4"}


def test_licences_planted_into_documents_equal_sql(spark, docs, tmp_path):
    import duckdb

    plant = spark.createDataFrame([(900_000 + i, f"Copyright (c) 20{i:02d} Author {i}\n" + re.sub(" (?=[a-f])", "\n" if i % 2 else "  ", t)) for i, (_, t) in enumerate(licences.KNOWN)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(plant)
    table.coalesce(1).write.parquet(f"{tmp_path}/t")
    got = sorted((r["doc_id"], r["digest"], r["license"], r["notices"]) for r in licences.scan(table).collect())
    want = sorted(duckdb.sql(licences.oracle(f"'{tmp_path}/t/*.parquet'")).fetchall())
    assert got == want
    assert [x[2] for x in got if x[0] >= 900_000] == [i for i, _ in licences.KNOWN]


def test_many_spans_in_one_text(spark):
    import time

    df = spark.createDataFrame([(1, " ".join(f"user{i}@mail{i}.com" for i in range(20000)))], "doc_id long, text string")
    began = time.time()
    spans = df.select(pii.base_spans(F.col("text")).alias("b")).first()["b"]
    assert len(spans) == 20000 and spans[-1]["value"] == "user19999@mail19999.com" and spans[-1]["s"] == sum(len(x["value"]) + 1 for x in spans[:-1])
    assert time.time() - began < 20
