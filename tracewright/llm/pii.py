"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

The base spans (email, ip, card, phone) come from patterns. A term in the documents of a protected value can give it away as well: from
co-occurrence counts by document over the whole corpus, a term whose pointwise mutual information with a value reaches the share ``alpha`` of the
value's own information content, log p(value | term) >= (1 - alpha) log p(value), discloses it and becomes a span too. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# What counts as each kind. Each pattern finds the leftmost longest matches; the look-behind only skips starts that
# a match cannot begin at, and possessive repeats only give up ways back that cannot succeed, so that long runs stay linear.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: Share of a value's information that discloses it; most pseudo-documents in the smoothed estimate.
ALPHA, PRIOR = 0.9, 5
#: Lengths that are added up in one piece.
CHUNK = 256
SPAN = "array<struct<s:int,k:int,e:int,kind:string,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def step(acc, i):
        v = F.substr(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = v * 2 - F.when(v > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), step) % 10 == 0


def _keeps(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _running(x: Column) -> Column:
    """Running sums of an array of lengths. Sums are appended within chunks of CHUNK only, so that long arrays take linear time."""
    zero = F.array().cast("array<int>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / CHUNK).cast("int") - 1, F.lit(0))), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v))
    before = F.aggregate(sums, F.struct(F.lit(0).alias("at"), zero.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    inside = lambda c, b: F.aggregate(c, F.struct(b.alias("at"), zero.alias("out")), lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"] + v).alias("out")), lambda a: a["out"])
    return F.flatten(F.zip_with(chunks, before, inside))


def _ends(hits: Column, gaps: Column) -> Column:
    """Where each match ends, from the matches and the pieces around them, in code points."""
    return _running(F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda m, g: F.length(m) + F.length(g)))


def _found(text: Column, kind: str, pattern: str, needs: Column) -> Column:
    """Spans of one kind: the pieces between the matches and the matches themselves give the positions, in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda m, e: F.struct((e - F.length(m)).alias("s"), F.lit(KINDS.index(kind)).alias("k"), e.alias("e"), F.lit(kind).alias("kind"), m.alias("value"))
    spans = F.filter(F.zip_with(hits, _ends(hits, F.split(text, pattern, -1)), one), lambda x: _keeps(kind, x["value"]))
    return F.when(needs, spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind in the order email, ip, card, phone; positions in code points, end exclusive. Null: none."""
    t = F.coalesce(text, F.lit(""))
    parts = [
        _found(t, "email", EMAIL, F.contains(t, F.lit("@"))),
        _found(t, "ip", IP, t.rlike(r"[0-9]\.[0-9]")),
        _found(t, "card", CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        _found(t, "phone", PHONE, t.rlike(r"\+[0-9]")),
    ]
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _value(kind: Column, value: Column) -> Column:
    """A value as an entity: an address in lower case, a number by its digits."""
    return F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value))


def _words(text: Column) -> Column:
    """The distinct words in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+")), F.lower))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of its base spans, as long as before: what is left are the words outside, at their places."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        s = F.greatest(acc["at"], x["s"])
        more = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(" "), x["e"] - s)))
        return F.when(x["e"] > acc["at"], F.struct(x["e"].alias("at"), more.alias("out"))).otherwise(acc)

    return F.aggregate(base, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def disclosing(docs: DataFrame, terms: DataFrame, held: DataFrame, alpha: float) -> DataFrame:
    """(term, several): the terms of ``docs`` (text) that disclose some value, and whether they occur with one in two different texts or more. ``terms`` (digest, term) are the distinct words of each
    document with values, ``held`` (digest, entity) its values; documents with equal texts have equal digests.

    All counts are of documents in the whole corpus, copies included: p(value) = of_entity / n, p(value | term) = both / (of_term + k) with k = min(of_entity, PRIOR)
    pseudo-documents without the value. What is left out before the pairs are made cannot reach the bar: both is at most of_entity and at most the
    documents that hold the term and any value. A term of one text has the same count with each of its values, so the rarest one decides without pairs.
    Pairs are made for each different text, with its number of copies; words that cannot reach the bar are left out before they are shuffled.
    """
    n = F.lit(float(max(1, docs.where(F.col("text").isNotNull()).count())))
    bar = lambda of: F.pow(of / n, F.lit(1 - alpha))
    prior = lambda of: F.least(of, F.lit(PRIOR))
    values = held.groupBy("digest", "entity").agg(F.count("*").alias("copies"))
    of_entity = values.groupBy("entity").agg(F.sum("copies").alias("of_entity"))
    values = written(values.select("digest", "entity").join(of_entity, "entity"), "values")
    count = docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("of_term"))
    near = terms.groupBy("term").agg(F.count("*").alias("near"), F.min("digest").alias("digest"), F.max("digest").alias("last"))
    near = near.join(count, "term").withColumn("of_term", F.greatest("of_term", "near"))
    near = written(near.where(F.col("near") / (F.col("of_term") + 1) >= bar(F.lit(1.0))), "near")
    rarest = values.groupBy("digest").agg(F.min("of_entity").alias("of_entity"))
    lone = near.where("digest = last").join(rarest, "digest").select("term", "of_term", "of_entity", F.col("near").alias("both"), F.lit(False).alias("several"))
    multi = near.where("digest <> last").select("term", "of_term")
    may = _maybe(multi.select("term"))
    pairs = terms.where(may("term")).join(multi, "term").groupBy("digest", "term", "of_term").agg(F.count("*").alias("copies")).join(values, "digest")
    pairs = pairs.where(F.col("of_entity") / (F.col("of_term") + prior(F.col("of_entity"))) >= bar(F.col("of_entity")))
    pairs = pairs.groupBy("entity", "term", "of_term", "of_entity").agg(F.sum("copies").alias("both"), (F.count("*") > 1).alias("several")).select(lone.columns)
    p = lone.unionByName(pairs)
    return p.where(F.col("both") / (F.col("of_term") + prior(F.col("of_entity"))) >= bar(F.col("of_entity"))).groupBy("term").agg(F.max("several").alias("several"))


def _maybe(terms: DataFrame, most: int = 1 << 23) -> Callable[[str], Column]:
    """A test on a column that lets every one of ``terms`` (one column) and few others pass, so that only those meet the terms in a join. It is a table
    of at most ``most`` hash bits (1 MB at any size of the corpus); with more terms than bits more words pass and the join decides as before."""
    bits = min(most, 1 << max(12, (16 * terms.count()).bit_length()))
    at = lambda w: F.pmod(F.xxhash64(w, F.lit(9)), F.lit(bits))
    held = terms.select(at(terms.columns[0]).alias("at")).select(F.floor(F.col("at") / 64).alias("id"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    rows = terms.sparkSession.range(bits // 64).join(held.groupBy("id").agg(F.bit_or("bit").alias("bit")), "id", "left")
    table = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit")))), lambda x: x["bit"])).scalar()
    return lambda w: F.getbit(F.get(table, F.floor(at(w) / 64).cast("int")), at(w) % 64) == 1


WORD = r"[\p{L}\p{N}]+"


def _places(texts: DataFrame, bad: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """((of, terms), test): for each text (digest, rest) with words in ``bad`` (term) the spans of all their occurrences, and a test on digests that these pass and few others.

    No text is shuffled: words that may be terms meet them in a join, which leaves the digests of the texts to look at again; those are found by their bit where they are read, and their
    words' places come out with the words."""
    may = _maybe(bad)
    which = texts.select("digest", F.explode(_words(F.col("rest"))).alias("term")).where(may("term")).join(bad, "term", "left_semi").select("digest").distinct()
    here = _maybe(written(which, "texts_that_tell"))
    x = texts.where(here("digest")).select("digest", F.regexp_extract_all("rest", F.lit(WORD), F.lit(0)).alias("hits"), F.split("rest", WORD, -1).alias("gaps"))
    x = x.select("digest", "hits", _ends(F.col("hits"), F.col("gaps")).alias("ends"))
    x = x.select("digest", F.explode(F.arrays_zip("hits", "ends")).alias("w")).select("digest", F.lower("w.hits").alias("term"), (F.col("w.ends") - F.length("w.hits")).alias("s"), F.col("w.ends").alias("e"))
    x = x.where(may("term")).join(bad, "term", "left_semi")
    one = F.struct("s", F.lit(len(KINDS)).alias("k"), "e", F.lit("term").alias("kind"), F.col("term").alias("value"))
    return x.groupBy(F.col("digest").alias("of")).agg(F.array_sort(F.collect_set(one)).cast(SPAN).alias("terms")), here


def sanitised(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (arrays of struct s, k, e, kind, value), old columns of these names replaced; columns of any other name are kept.

    spans holds the base spans and every occurrence outside of them of a term (kind "term", k = 4) that discloses a value of the corpus, in this row or
    another. In rows without a base span, which do not print the value, a term counts if it was met with the value in two different texts or more: met in one, it says nothing on others.
    Equal texts get equal spans; null texts count as empty. Terms are counted by document, copies included. Nothing is capped: a value in very many rows is only one
    key of pre-aggregated counts. Only rows with terms meet their spans in a join; all others pass as they are read.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # no name of docs is met below
    cols, text = rows.columns, f"c{names.index('text')}"
    docs = rows.select(F.col(text).alias("text"))
    maybe = F.coalesce(F.contains(text, F.lit("@")) | F.col(text).rlike("[0-9]"), F.lit(False))
    few = rows.where(maybe).withColumn("base", base_spans(F.col(text)))
    few = written(few.withColumn("rest", F.when(F.size("base") > 0, _blanked(F.col(text), F.col("base")))), "candidates")
    none = F.array().cast(SPAN)
    hit = few.where("rest is not null").withColumn("digest", F.md5(text))
    entity = F.array_distinct(F.transform("base", lambda b: F.concat_ws(":", b["kind"], _value(b["kind"], b["value"]))))
    terms = hit.select("digest", F.explode(_words(F.col("rest"))).alias("term")).where("term <> ''")
    bad = written(disclosing(docs, terms, hit.select("digest", F.explode(entity).alias("entity")), alpha), "disclosing")
    plain = few.where("rest is null").select(*cols, F.col(text).alias("rest")).unionByName(rows.where(~maybe).withColumn("rest", F.col(text)))
    plain = plain.select(*cols, none.alias("base"), "rest", F.md5(text).alias("digest"))

    def marked(rows: DataFrame, bad: DataFrame) -> DataFrame:
        places, here = _places(rows.select("digest", "rest"), bad)
        yes = rows.where(F.coalesce(here("digest"), F.lit(False))).join(places, F.col("digest") == F.col("of"), "left")
        spans = lambda terms: F.array_sort(F.concat("base", terms)).alias("spans")
        no = rows.where(~F.coalesce(here("digest"), F.lit(False)))
        return yes.select(*cols, "base", spans(F.coalesce("terms", none))).unionByName(no.select(*cols, "base", F.col("base").alias("spans")))

    # Rows without a value: only terms met in several texts count.
    out = marked(hit, bad.select("term")).unionByName(marked(plain, bad.where("several").select("term")))
    return out.toDF(*names, "base", "spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets ([EMAIL]); of overlapping spans the first names the stretch."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest_row(spans_of: DataFrame) -> DataFrame:
    """doc_id, one count for each base kind, base_sha256 and spans of a sanitised table."""
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return spans_of.select("doc_id", *n, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
