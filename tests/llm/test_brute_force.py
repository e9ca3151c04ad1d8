"""Operators without SQL against plain computations of the same rule on small tables."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import language, pii, quality, simhash, stages, toxicity

SF = "/root/testdata/sf0.001"


def test_language_posterior(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = pages.collect()
    html = [None if r["html"] is None else r["html"].encode() for r in rows]
    said, at, grams = [language.declared(h) for h in html], [language.places(r["url"]) for r in rows], [language.grams(h) for h in html]
    texts, every = Counter(s for s, g in zip(said, grams, strict=True) if s and g.any()), Counter(filter(None, said))
    langs = sorted(x for x in every if texts[x] >= language.ENOUGH or every[x] >= language.LEAST * sum(every.values()))
    table = np.array([sum(g / max(g.sum(), 1) for s, g in zip(said, grams, strict=True) if s == x) + 1e-3 for x in langs])
    table = np.log(table / table.sum(axis=1, keepdims=True))
    ll = [table @ g / max(g.sum(), 1) * min(g.sum(), language.EVIDENCE) for g in grams]
    p = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in ll]
    best = [langs[int(x.argmax())] if g.any() else None for x, g in zip(p, grams, strict=True)]
    known = [(s, b) for s, b in zip(said, best, strict=True) if s in langs and b]
    trust = min(0.99, (sum(s == b for s, b in known) + 1) / (len(known) + 2))
    n = defaultdict(float)
    for x, (host, domain, suffix) in zip(p, at, strict=True):
        for key in (("h", host, domain, suffix), ("d", domain, suffix), ("s", suffix), ("a",)):
            n[key] = n[key] + x
    got = {r["page_id"]: r for r in language.identify(pages).collect()}
    for r, x, (host, domain, suffix), s, y in zip(rows, p, at, said, ll, strict=True):
        prior = np.full(len(langs), 1 / len(langs))
        for key in (("a",), ("s", suffix), ("d", domain, suffix), ("h", host, domain, suffix)):
            left = np.maximum(n[key] - x, 0)
            prior = (left + language.SMOOTHING * prior) / (left.sum() + language.SMOOTHING)
        score = y + np.log(prior) + (np.where(np.array(langs) == s, math.log(trust), math.log((1 - trust) / (len(langs) - 1))) if s in langs else 0)
        post = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert got[r["page_id"]]["lang"] == langs[int(post.argmax())]
        assert got[r["page_id"]]["probability"] == pytest.approx(post.max(), abs=2e-6)


def test_quality_vote(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True), per_class=40)
    for r in quality.score(docs.select("doc_id", "text").limit(60), model).collect():
        v = model.embed(quality.term_counts((r["text"] or "").encode())[None])[0]
        cos = sorted(((float(v @ x), y) for x, y in zip(model.vectors, model.y, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0) ** quality.SHARPNESS for c, _ in cos]
        want = sum(a * y for a, (_, y) in zip(w, cos, strict=True)) / sum(w) if sum(w) > 1e-9 else model.prior
        assert r["score"] == pytest.approx(want, abs=1e-4)


def plain_kernel(a, b):
    """Gapped common subsequences of four characters by enumeration."""

    def parts(w):
        w, out = "^" + w, defaultdict(float)
        for at in combinations(range(len(w)), 4):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(w[i] for i in at), at[-1] - at[0]] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    def product(x, y):
        sums = [defaultdict(float), defaultdict(float)]
        for s, p in zip(sums, (x, y), strict=True):
            for (letters, _), v in p.items():
                s[letters] += v
        return sum(v * sums[1][k] for k, v in sums[0].items())

    # an item's norm follows from its length: every place counts once
    norm = lambda w: math.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for at in combinations(range(len(w) + 1), 4) if at[-1] - at[0] < toxicity.SPAN) or 1)
    return product(parts(a), parts(b)) / norm(a) / norm(b)


def test_toxicity_kernel_and_collapsed_weights():
    words = ["gormless", "gorm-less", "gormlss", "nitwick", "идиот", "иди.от", "спасибо", "漢字仮名", "漢字かな", "blockhead", "theory", "ab", "a", "", "goormlesss"]
    got = toxicity.kernel(words, words)
    want = np.array([[plain_kernel(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    assert got[4, 6] == 0 and got[4, 5] > 0.2  # letters of other scripts are told apart
    marks = words[:6]
    m = toxicity.machine(words, np.array([1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1]), marks)
    alpha = np.linalg.lstsq(toxicity.kernel(marks, marks).astype(float), m.margins(marks) - m.bias, rcond=None)[0]
    assert np.allclose(m.margins(words) - m.bias, toxicity.kernel(words, marks) @ alpha, atol=1e-3)


def test_disclosing_terms(spark):
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    values = [f"p{i}@mail.example" for i in range(6)]
    texts = []
    for _ in range(260):
        t = [words[int(x)] for x in np.minimum(rng.zipf(1.3, 6), 150) - 1]
        if rng.random() < 0.2:
            v = int(rng.integers(0, 6))
            t += [values[v]] + ([f"name{v}"] if rng.random() < 0.8 else [])
        texts.append(" ".join(t))
    texts += [texts[0], None, "", "name0 name1 alone"]
    alpha, n = 0.7, sum(t is not None for t in texts)
    own = [(set(re.findall(r"[^ ]+@[^ ]+", t or "")), {w for w in re.sub(r"[^ ]+@[^ ]+", " ", t or "").split()}) for t in texts]
    of_value, of_term = Counter(v for vs, _ in own for v in vs), Counter(w for t in texts for w in set(re.findall(r"[^\W_]+", t or "")))
    both, kinds = Counter(), defaultdict(set)
    for (vs, ws), t in zip(own, texts, strict=True):
        for v in vs:
            for w in ws:
                both[v, w] += 1
                kinds[v, w].add(t)
    bad = {(v, w) for (v, w), b in both.items() if b / (of_term[w] + min(of_value[v], pii.PRIOR)) >= (of_value[v] / n) ** (1 - alpha)}
    anywhere, told = {w for _, w in bad}, {w for v, w in bad if len(kinds[v, w]) > 1}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert anywhere and told and "name0" in told
    for r in pii.sanitised(df, alpha=alpha).collect():
        vs, ws = own[r["doc_id"]]
        assert {x["value"] for x in r["spans"] if x["kind"] == "term"} == ws & (anywhere if vs else told), r["text"]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_texts_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, pairs = [], []
    for k in range(150):
        a = [word() for _ in range(220)]
        b = list(a)
        for at in rng.choice(220, int(rng.integers(1, 12)), replace=False):
            b[at] = word()
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = shingles(rows[-2][1]), shingles(rows[-1][1])
        pairs.append(len(x & y) / len(x | y))
    got = {r["doc_id"]: r["root"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = [got[2 * k] == got[2 * k + 1] for k in range(150)]
    near = [s for s, j in zip(same, pairs, strict=True) if j >= 0.8]
    assert len(near) > 20 and np.mean(near) >= 0.9
    assert not any(s for s, j in zip(same, pairs, strict=True) if j < 0.45)
    classes = Counter(got.values())
    assert max(classes.values()) == 2  # nothing links across pairs
    with pytest.raises(ValueError, match="radius"):
        simhash.plan(10, np.zeros((64, 64)), 64)
    assert simhash.plan(1000, np.full((64, 64), 250.0) + 250 * np.eye(64), 24)


def test_pipeline_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = stages.near_duplicates_out(spark, docs, SF).collect()
    roots = {(r["doc_id"], r["digest"]): r["root"] for r in simhash.similar_classes(docs).collect()}
    first = {}
    for (i, _), root in sorted(roots.items()):
        first.setdefault(root, i)
    assert sorted(r["doc_id"] for r in kept) == sorted(first.values())
    spans = {r["doc_id"]: r["spans"] for r in pii.sanitised(docs).collect()}
    for r in stages.personal_data_out(spark, docs, SF).join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect():
        out, at = "", 0
        for x in spans[r["doc_id"]]:
            if x["s"] >= at:
                out += r["old"][at : x["s"]] + f"[{x['kind'].upper()}]"
            at = max(at, x["e"])
        assert r["text"] == out + r["old"][at:] and (not spans[r["doc_id"]] or r["n_chars"] == len(r["text"]))


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (None, b), (None, "lone words here"), (5, b)], "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in simhash.dedup(df).collect())
    assert got == [(-1, "lone words here"), (3, a), (5, b)]
