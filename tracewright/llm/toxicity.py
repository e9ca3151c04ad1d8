"""Toxicity by a support vector machine on a gapped subsequence string kernel with Nystroem landmarks.

The kernel compares two segments (words, or runs of single characters such as "i d i o t") by their common subsequences of
four characters; one that spans more places than four weighs less, so inserted characters lower a match but do not
hide it. Sentences are the training instances: a sentence counts by its most telling segment (multiple-instance learning). The
Nystroem map is linear in the landmarks' subsequences, so the trained machine collapses, exactly, to one weight for each subsequence.
Sentences, words and margins are counted and compared by Spark; the driver gets bounded lists of words, never texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_ids, with_columns, written

#: Subsequence length, longest span in a segment, weight of each place that a subsequence spans.
LENGTH, SPAN, DECAY = 4, 6, 0.7
PATTERNS = [(0, *inner, span - 1) for span in range(LENGTH, SPAN + 1) for inner in combinations(range(1, span - 1), LENGTH - 2)]
WEIGHTS = [DECAY ** (p[-1] + 1) for p in PATTERNS]
LANDMARKS, ROUNDS, CACHE = 400, 3, 50_000
#: Words that reach the driver: telling words of toxic sentences, clean words taken by hash, clean words taken by margin in each further round.
TELLING, NEGATIVE, HARD = 5000, 6000, 3000
#: Between sentences: closing punctuation before white space (not inside a word, where it may hide an insult), or a line break.
SENTENCE = re.compile(r"(?:[.!?]+(?=\s|$)|\n)+")
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»¿¡“”„…"


def segments(text: str) -> set[str]:
    """The distinct segments of a text: its lower-cased words without outer punctuation, and runs of three or more single
    characters joined."""
    words = text.lower().split()
    found = set(words)
    if sum(len(w) == 1 for w in found) > 1:
        run: list[str] = []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) > 2:
                    found.add("".join(run))
                run = []
    return found


#: Subsequences are numbered by a linear hash of their four code points, so that every script keeps its letters apart; two of the few hundred
#: thousand subsequences of a language share a number about as often as 1 in 20.
BITS = 22
CODES = 1 << BITS
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def codes(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all items, each with a mark before its first character and padded with zeros so that no subsequence crosses to the next; where each item
    starts; its norm (1 if it has no subsequence), which follows from its length."""
    bare = ["^" + w.strip(EDGES).replace("\0", "") for w in items]
    sym = np.frombuffer(("\0" * (SPAN - 1)).join([*bare, ""]).encode("utf-32-le", "replace"), np.uint32)
    lens = np.fromiter(map(len, bare), np.int64, len(bare))
    square = sum(np.maximum(lens - p[-1], 0) * w * w for p, w in zip(PATTERNS, WEIGHTS, strict=True))
    return np.concatenate([sym, np.zeros(SPAN, np.uint32)]), np.cumsum(lens + SPAN - 1) - lens - SPAN + 1, np.sqrt(np.where(square > 0, square, 1))


def windows(sym: np.ndarray):
    """For each pattern the number of the subsequence from each position, and which positions have one: both its ends lie in an item, so no zero between."""
    n = len(sym) - SPAN
    scaled = [sym * f for f in _FACTORS]
    inside = sym > 0
    for p in PATTERNS:
        total = scaled[0][:n] + scaled[1][p[1] : p[1] + n] + scaled[2][p[2] : p[2] + n] + scaled[3][p[3] : p[3] + n]
        yield (total ^ total >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - BITS), inside[:n] & inside[p[3] : p[3] + n]


def features(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, subsequence number, weight) of every subsequence occurrence, and the norm of each item."""
    sym, starts, norm = codes(items)
    own, at, keys, weights = np.zeros(len(sym), np.int64), [], [], []
    own[starts[1:]] = 1
    own = np.cumsum(own)
    for (code, ok), w in zip(windows(sym), WEIGHTS, strict=True):
        i = np.flatnonzero(ok)
        at.append(own[i])
        keys.append(code[i])
        weights.append(np.full(len(i), w))
    return np.concatenate(at), np.concatenate(keys).astype(np.int64), np.concatenate(weights), norm


@dataclass
class KernelMachine:
    """One weight for each of the 2^22 subsequence numbers (16 MB at any size): safe to broadcast."""

    values: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    seen: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def margins(self, items: list[str]) -> np.ndarray:
        out = np.zeros(len(items))
        for a in range(0, len(items), 20_000):
            part = items[a : a + 20_000]
            sym, starts, norm = codes(part)
            total = np.zeros(len(sym) - SPAN, np.float32)
            for (code, ok), w in zip(windows(sym), WEIGHTS, strict=True):
                total += np.where(ok, self.values[code], np.float32(0)) * np.float32(w)
            out[a : a + len(part)] = np.add.reduceat(np.append(total, np.float32(0)), starts) / norm
        return out + self.bias

    def of(self, found: list[set[str]]) -> np.ndarray:
        """The largest margin in each set of segments; the bias alone for an empty one."""
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        new = sorted({w for f in found for w in f if w not in seen})
        seen.update(zip(new, self.margins(new).tolist(), strict=True))
        return np.array([max(map(seen.__getitem__, f), default=self.bias) for f in found])

    def score(self, texts: list[str | None]) -> np.ndarray:
        best = self.of([segments(t or "") for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -50, 50)))


def kernel(items: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel values, len(items) x len(marks)."""
    a, ka, wa, na = features(marks)
    keys, where = np.unique(ka, return_inverse=True)
    table = np.zeros((len(keys), len(marks)), np.float32)
    np.add.at(table, (where, a), wa / na[a])
    at, kb, wb, nb = features(items)
    out = np.zeros((len(items), len(marks)), np.float32)
    if len(keys) and len(kb):
        pos = np.searchsorted(keys, kb).clip(0, len(keys) - 1)
        hit = np.flatnonzero(keys[pos] == kb)
        hit = hit[np.argsort(at[hit], kind="stable")]
        rows = max(1, (1 << 21) // len(keys))  # at most 16 MB of features at once
        for s in range(0, len(items), rows):
            h = hit[np.searchsorted(at[hit], s) : np.searchsorted(at[hit], s + rows)]
            n = min(rows, len(items) - s)
            phi = np.bincount((at[h] - s) * len(keys) + pos[h], wb[h] / nb[at[h]], minlength=n * len(keys)).reshape(n, -1)
            out[s : s + n] = phi.astype(np.float32) @ table
    return out


def machine(items: list[str], y: np.ndarray, marks: list[str], c: float = 1.0) -> KernelMachine:
    """Squared-hinge machine on the Nystroem features of items, classes weighted alike, as weights of subsequences."""
    val, vec = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vec * (1 / np.sqrt(np.maximum(val, 1e-3)))  # K^-1/2 up to a rotation
    z = np.hstack([kernel(items, marks) @ root, np.ones((len(items), 1))])
    s, cost = np.where(y > 0, 1.0, -1.0), np.where(y > 0, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (len(y) - y.sum()))) * c
    w, reg = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-3)
    for _ in range(25):
        on = s * (z @ w) < 1
        zo = z[on] * cost[on, None]
        new = np.linalg.solve(np.diag(reg) + zo.T @ z[on], zo.T @ s[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    a, ka, wa, na = features(marks)
    return KernelMachine(np.bincount(ka, wa / na[a] * (root @ w[:-1])[a], minlength=CODES).astype(np.float32), float(w[-1]))


def _cover(bags: list[set[str]]) -> set[str]:
    """Words that between them occur in the toxic texts: again and again the one in most texts that none covers yet, down to three texts."""
    where: dict[str, list[int]] = {}
    for i, b in enumerate(bags):
        for w in b:
            where.setdefault(w, []).append(i)
    count, chosen, covered = {w: len(i) for w, i in where.items()}, set(), set()
    while count:
        w = max(sorted(count), key=count.get)
        if count[w] < 3:
            break
        chosen.add(w)
        for i in where[w]:
            if i not in covered:
                covered.add(i)
                for x in bags[i]:
                    if x in count:
                        count[x] -= 1
        count.pop(w, None)
    return chosen


def instances(docs: DataFrame, labels: DataFrame, keep, label: str, per_class: int) -> DataFrame:
    """(y, doc_id, line, words): the sentences of at most ``per_class`` labelled documents of each class, whole texts of any length, as the hash of
    the sentence and its segments. A document without sentences has one row without words. Of rows that share an id the least text stands for the document."""

    def run(batches):
        for b in (whole.slice(at, 250) for whole in batches for at in range(0, whole.num_rows, 250)):
            for y, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = {x.strip() for x in SENTENCE.split(t or "")} - {""}
                rows = [(hash_of(x), sorted(segments(x))) for x in sorted(lines)] or [(0, [])]
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    cols = [pa.array([y] * len(part), pa.int32()), pa.array([i] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["y", "doc_id", "line", "words"])

    ids = F.broadcast(labelled_ids(labels, label, keep, per_class))  # 2 x per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    return rows.select("y", "doc_id", "text").mapInArrow(run, "y int, doc_id long, line long, words array<string>")


def fit(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", per_class: int = 2000) -> KernelMachine:
    """Train on at most ``per_class`` labelled documents of each class, whole texts. Sentences of documents with label 0 are negative, by their most toxic
    segment; the others are positive if they hold a telling word: one of those that cover the toxic documents and hardly occur in clean
    sentences, later also any that the machine itself finds. The driver gets words and one margin for each document: TELLING + NEGATIVE + ROUNDS x HARD
    words and 2 x per_class rows, whatever the size of the corpus or of a text."""
    rows = written(instances(docs, labels, keep, label, per_class), "sentences")
    spark = rows.sparkSession
    by_class = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not by_class.get(0) or not by_class.get(1):
        return KernelMachine(np.zeros(CODES, np.float32), 1.0 if by_class.get(1) else -1.0)
    lines = rows.where(F.size("words") > 0).select("y", "line", "words").dropDuplicates(["y", "line"])  # sentences of copies count once
    n_lines = {r["y"]: r["n"] for r in lines.groupBy("y").agg(F.count("*").alias("n")).collect()}
    words = lines.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.sum(F.col("y")).alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    words = written(words.where(F.length(F.btrim("w", F.lit(EDGES))) >= LENGTH), "words")
    share = (F.col("n1") / n_lines.get(1, 1)) / ((F.col("n0") + 0.2) / max(1, n_lines.get(0, 0)))
    telling = words.where((F.col("n1") >= 3) & (share > 10)).orderBy(F.desc("n1"), "w").limit(TELLING).collect()
    usable = {r["w"]: r["n1"] for r in telling}
    if not usable:  # nothing recurs: the commonest words of toxic sentences stand in
        usable = {r["w"]: r["n1"] for r in words.where("n1 > 0").orderBy(F.desc(share), F.desc("n1"), "w").limit(50).collect()}
    held = spark.createDataFrame(sorted(usable.items()), "w string, n1 long").select("w")
    bags: dict[int, set[str]] = {}
    for r in rows.where("y = 1").select("doc_id", F.explode("words").alias("w")).join(F.broadcast(held), "w").groupBy("doc_id").agg(F.collect_set("w").alias("ws")).collect():
        bags[r["doc_id"]] = set(r["ws"])
    positive = _cover([bags[k] for k in sorted(bags)]) or set(usable)
    positive |= {w for w, n in usable.items() if n > 0.5 * np.median([usable[x] for x in positive])}
    clean = words.where("n0 > 0").select("w")
    near = [r["w"] for r in clean.where(~F.col("w").isin(sorted(positive))).orderBy(F.xxhash64("w", F.lit(5)), "w").limit(NEGATIVE).collect()]
    for turn in range(ROUNDS):
        if turn:
            near = sorted({*near, *_hardest(lines.where("y = 0"), found)} - positive, key=hash_of)
        marks = sorted(positive, key=hash_of)[: LANDMARKS // 2] + near[: LANDMARKS // 2]
        known = sorted({v for w in positive for v in (w, *broken(w))})  # also with a character put in
        found = machine(known + near, np.array([1] * len(known) + [0] * len(near)), marks)
        some = sorted(usable)
        positive = positive | {w for w, m in zip(some, found.margins(some), strict=True) if m > 0.3}
    tops, held = _tops(rows, found)
    top = tops.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("m").alias("m")).select("y", "m").toArrow()
    held.destroy()
    y, m = top["y"].to_numpy(), top["m"].to_numpy()
    order = np.lexsort((m, y))
    found.scale, found.shift = _platt(m[order], y[order].astype(float))
    found.seen = {}
    return found


def _tops(rows: DataFrame, found: KernelMachine) -> tuple[DataFrame, Broadcast]:
    """(y, doc_id, w, m): the segment with the largest margin of each sentence, by name among equals; the bias for one without segments. Also the
    broadcast machine, to be destroyed once the rows have been read, so that workers do not keep the machines of all rounds."""
    held = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lists = part.column(2).to_pylist()
                held.value.of([set(x) for x in lists])
                seen = held.value.seen
                best = [max(x, key=lambda w: (seen[w], w), default=None) for x in lists]
                m = [held.value.bias if w is None else seen[w] for w in best]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(m, pa.float64())], ["y", "doc_id", "w", "m"])

    return rows.select("y", F.col("doc_id") if "doc_id" in rows.columns else F.lit(0).cast("long").alias("doc_id"), "words").mapInArrow(run, "y int, doc_id long, w string, m double"), held


def _hardest(lines: DataFrame, found: KernelMachine) -> list[str]:
    """Of the most toxic segments of clean sentences the HARD ones with the largest margins."""
    tops, held = _tops(lines, found)
    top = tops.where(F.length("w") >= LENGTH).groupBy("w").agg(F.max("m").alias("m"))
    hard = [r["w"] for r in top.orderBy(F.desc("m"), "w").limit(HARD).collect()]
    held.destroy()
    return hard


def broken(w: str) -> list[str]:
    """The word with one sign put in, at each place inside it."""
    return [w[:at] + "*-._"[(at + hash_of(w)) % 4] + w[at:] for at in range(1, len(w))]


def hash_of(w: str) -> int:
    h = 2166136261
    for b in w.encode("utf-8", "replace"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h ^ h >> 15


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on margins with smoothed targets, classes weighted alike."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w, ab = np.stack([m, np.ones_like(m)], 1), np.where(y > 0, 1 / max(y.sum(), 1), 1 / max(len(y) - y.sum(), 1)) * len(y), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (w * (p - t)) + 1e-3 * ab)
        ab = ab - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def score(docs: DataFrame, machine: KernelMachine) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier), an old column of that name replaced. Whole texts count. Null, empty and blank
    texts get the score of the bias alone (low, unless no clean row was labelled); equal texts get equal scores."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                yield with_columns(part, {"score": pa.array(held.value.score(part.column("text").to_pylist()), pa.float64())})
        held.value.seen.clear()  # a worker that goes on to other work keeps no words

    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "score"] + ["score double"])
    return docs.select([c for c in docs.columns if c != "score"]).mapInArrow(run, schema)
