"""Language identification of web pages by Bayesian evidence fusion.

Three kinds of evidence are added as log odds: the text (hashed byte trigrams under one multinomial for each language), the language that
the markup declares (right with an estimated reliability), and where the page lies: the languages of the other pages of its host, smoothed towards its
domain, its address suffix and the whole corpus. All counts are grouped aggregations over all pages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hash buckets; how many trigrams of a text count at most as independent evidence; pseudo-pages of each smoothing level; pages with
#: text that are enough for the model of a language, however large the corpus; in small corpora this share of the declaring pages is enough, too.
FEATURES, EVIDENCE, SMOOTHING, ENOUGH, LEAST = 4096, 60.0, 5.0, 20, 0.01
_DROP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;", re.S | re.I)
#: What an <html> inside does not count of; without an end it runs to the end of the page.
_HIDDEN = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HTML = re.compile(rb"<html\b[^>]*>", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)")


def grams(html: bytes | None) -> np.ndarray:
    """Counts of hashed byte trigrams of the visible text, lower-cased, white space as one blank."""
    words = _DROP.sub(b" ", html or b"").lower().split()
    x = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(words) == 0:
        return np.zeros(FEATURES)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES).astype(float)


def declared(html: bytes | None) -> str | None:
    """The language of the first <html> tag that names one, wherever it lies in the page; every tag ends, if only with the page, so this is linear."""
    for tag in _HTML.finditer(_HIDDEN.sub(b" ", html or b"") + b">"):
        if m := _LANG.search(tag[0]):
            return m[1].decode().lower()
    return None


def places(url: str | None) -> tuple[str, str, str]:
    """Host without www, its domain (last two labels) and address suffix (last label), in lower case; empty if there is none."""
    m = _HOST.match(url or "")
    host = m[1].lower().strip(".").removeprefix("www.") if m else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def text_model(pages: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages declared on ENOUGH pages with text or on LEAST of the pages that declare one, and log P(bucket | language). Every page counts, under the language
    it declares; FEATURES numbers for each language reach the driver, whatever the number of pages."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        pages: dict[str, int] = {}
        texts: dict[str, int] = {}
        for b in batches:
            for h in b.column(0).cast(pa.binary()).to_pylist():
                lang = declared(h)
                if lang:
                    c = grams(h)
                    sums[lang] = sums.get(lang, 0) + c / max(c.sum(), 1)  # a long page weighs no more than a short one
                    pages[lang] = pages.get(lang, 0) + 1
                    texts[lang] = texts.get(lang, 0) + bool(c.any())
        for lang, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 2)), pa.array([*some, -1, -2], pa.int32()), pa.array([*c[some], float(pages[lang]), float(texts[lang])])], ["lang", "k", "c"])

    counts = pages.select("html").mapInArrow(run, "lang string, k int, c double").groupBy("lang", "k").agg(F.sum("c").alias("c"))
    counts = written(counts, "grams")
    n = counts.where("k = -1")
    total = n.agg(F.sum("c")).first()[0] or 0
    enough = ((F.col("k") == -1) & (F.col("c") >= LEAST * total)) | ((F.col("k") == -2) & (F.col("c") >= ENOUGH))
    langs = sorted(r["lang"] for r in counts.where(enough).select("lang").distinct().collect())
    table = np.full((len(langs), FEATURES), 1e-3)
    if langs:
        found = counts.where(F.col("lang").isin(langs) & (F.col("k") >= 0)).toArrow()
        table[np.searchsorted(langs, found["lang"].to_pylist()), found["k"].to_numpy()] += found["c"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def identify(pages: DataFrame) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, probability), one row for each row of ``pages`` (page_id, url, html).

    Null or empty html is no text evidence and no declaration; a null or odd url is the host "". Without any declared language in the corpus lang and
    probability are null. Ties go to the language first by name. Repeated rows are pages of their own; other columns are not looked at.
    """
    langs, model = text_model(pages)
    k = len(langs)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    held = pages.sparkSession.sparkContext.broadcast((langs, model.T.copy()))

    def run(batches):
        langs, weights = held.value
        for b in batches:
            htmls = b.column(2).cast(pa.binary()).to_pylist()
            at = [places(u) for u in b.column(1).to_pylist()]
            x = np.stack([grams(h) for h in htmls]) if htmls else np.zeros((0, FEATURES))
            n = x.sum(axis=1, keepdims=True)
            ll = (x @ weights) / np.maximum(n, 1) * np.minimum(n, EVIDENCE)
            p = np.exp(ll - ll.max(axis=1, keepdims=True)) if k else ll
            p = p / p.sum(axis=1, keepdims=True) if k else p
            said = [declared(h) for h in htmls]
            text = [langs[i] if s > 0 else None for i, s in zip(p.argmax(axis=1), n[:, 0], strict=True)] if k else [None] * len(htmls)
            cols = [b.column(0), *[pa.array([a[i] for a in at], pa.string()) for i in range(3)], pa.array(said, pa.string()), pa.array(text, pa.string()), pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(p.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "domain", "suffix", "declared", "text_lang", "ll", "p"])

    rows = base.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, text_lang string, ll array<double>, p array<double>")
    if not k:
        return rows.select("page_id", "host", "declared", "text_lang", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    rows = written(rows, "evidence")
    # How often a declaration agrees with the text, over all pages: how far it can be trusted.
    seen = rows.where(F.col("declared").isin(langs) & F.col("text_lang").isNotNull()).agg(F.count("*").alias("n"), F.sum((F.col("declared") == F.col("text_lang")).cast("long")).alias("same")).first()
    trust = min(0.99, ((seen["same"] or 0) + 1) / ((seen["n"] or 0) + 2))
    each = [F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)]
    host = rows.groupBy("host", "domain", "suffix").agg(*each)
    up = lambda df, *key: df.groupBy(*key).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)])
    arr = lambda df, name: df.select(*[c for c in df.columns if not re.fullmatch(r"n\d+", c)], F.array(*[F.col(f"n{i}") for i in range(k)]).alias(name))
    domain = up(host, "domain", "suffix")
    suffix = up(domain, "suffix")
    whole = arr(up(suffix.withColumn("one", F.lit(1)), "one"), "n_all").drop("one")
    own = arr(host, "n_host").join(arr(domain, "n_domain"), ["domain", "suffix"]).join(arr(suffix, "n_suffix"), "suffix").crossJoin(F.broadcast(whole))  # one row
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def smoothed(counts, parent):
        """Shares of counts without the page itself, drawn towards the parent level by SMOOTHING pseudo-pages."""
        left = F.zip_with(counts, F.col("p"), lambda n, x: F.greatest(n - x, F.lit(0.0)))
        return F.zip_with(left, parent, lambda n, q: (n + SMOOTHING * q) / (sum_(left) + SMOOTHING))

    j = rows.join(own, ["host", "domain", "suffix"])
    flat = F.array(*[F.lit(1.0 / k)] * k)
    j = j.withColumn("prior", smoothed(F.col("n_all"), flat))
    for level in ("n_suffix", "n_domain", "n_host"):
        j = j.withColumn("prior", smoothed(F.col(level), F.col("prior")))
    said = F.array(*[F.when(~F.coalesce(F.col("declared").isin(langs), F.lit(False)), 0.0).when(F.col("declared") == x, float(np.log(trust))).otherwise(float(np.log((1 - trust) / max(k - 1, 1)))) for x in langs])
    j = j.withColumn("score", F.zip_with(F.zip_with("ll", said, lambda a, b: a + b), "prior", lambda a, b: a + F.log(b)))
    j = j.withColumn("top", F.array_max("score"))
    best = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("score", F.col("top")).cast("int"))
    return j.select("page_id", "host", "declared", "text_lang", best.alias("lang"), F.round(1 / sum_(F.transform("score", lambda s: F.exp(s - F.col("top")))), 6).alias("probability"))
