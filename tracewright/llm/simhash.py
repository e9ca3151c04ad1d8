"""SimHash near-duplicates by generalised pigeonhole search over all fingerprints.

The bits are grouped into parts of correlated bits; a dynamic program deals a threshold to each part (none, or how many of its bits may differ)
by the number of candidate pairs that each part and threshold is estimated to give; equal keys are then probed and every candidate
is verified on the whole fingerprint. Two plans: ``plan`` finds every pair within a radius of 64 bits; ``likely_plan`` finds pairs of a stated similarity with a
stated probability, on fingerprints of 256 bits, where a radius wide enough for a similarity of 0.8 would need too many keys.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, min_labels, runs, written

#: What one probed key costs next to one verified candidate pair.
ROW_COST = 200.0
#: Buckets over this many fingerprints are cut into blocks that are compared two by two; pairs that a task compares at once; keys of one part and threshold.
BLOCK, AT_ONCE, MOST_KEYS = 256, 1 << 18, 5000
#: Bits set in each byte value, low bit first.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, shingle: int, words: int = 1) -> np.ndarray:
    """SimHash of the word shingles of a UTF-8 text as ``words`` (1 or 4) signed 64-bit numbers; zeros if it has no word. One number comes from
    XXH64 with seed 42, four from XXH3-128 with seeds 42 and 43."""
    tokens = (text or b"").lower().split()
    n, joined = len(tokens), b" ".join(tokens)
    if not n:
        return np.zeros(words, np.int64)
    if n <= shingle:
        spans = [joined]
    else:
        lens = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: n - shingle + 1].tolist()
        spans = [joined[i:j] for i, j in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    if words == 1:
        h = xxhash.xxh64_intdigest
        seen = np.array([h(s, 42) for s in spans], np.uint64).view(np.uint8).reshape(-1, 8)
    else:
        h = xxhash.xxh3_128_digest
        seen = np.frombuffer(b"".join([h(s, seed) for s in spans for seed in (42, 43)]), np.uint8).reshape(-1, 32)
    set_, at_byte = np.zeros(64 * words, np.int64), 256 * np.arange(8 * words)
    for at in range(0, len(seen), 4096):
        part = seen[at : at + 4096]
        if len(part) < 64:
            set_ += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            set_ += (np.bincount((part + at_byte).ravel(), minlength=2048 * words).reshape(-1, 256) @ _SET).ravel()
    return np.packbits(2 * set_ > len(seen), bitorder="little").view(np.int64)


def _names(words: int) -> list[str]:
    return [f"fp{k}" for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp0 ..): the digest (MD5, null counts as empty) and the fingerprint of each whole text. Null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            parts = (b.column(2).slice(at, 250).cast(pa.binary()).to_pylist() for at in range(0, b.num_rows, 250))
            fps = np.array([fingerprint(t, shingle, words) for part in parts for t in part], np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(fps[:, k]) for k in range(words)]], ["doc_id", "digest", *_names(words)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest string, " + ", ".join(f"{c} long" for c in _names(words)))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits j and k are both set."""
    names = [c for c in fps.columns if c.startswith("fp")]
    bits_n = 64 * len(names)

    def run(batches):
        n, c = 0, np.zeros((bits_n, bits_n))
        for b in batches:
            x = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))], axis=1)
            for at in range(0, len(x), 8192):
                bits = np.unpackbits(np.ascontiguousarray(x[at : at + 8192]).view(np.uint8).reshape(-1, bits_n // 8), axis=1, bitorder="little").astype(np.float32)
                c += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits_n * bits_n + 1), pa.int32()), pa.array(np.append(c.ravel(), n))], ["k", "c"])

    found = fps.select(names).mapInArrow(run, "k int, c double").groupBy("k").agg(F.sum("c").alias("c")).toArrow()  # bits x bits + 1 rows at any size
    c = np.zeros(bits_n * bits_n + 1)
    c[found["k"].to_numpy()] = found["c"].to_numpy()
    return int(c[-1]), c[:-1].reshape(bits_n, bits_n)


class Agreement:
    """Estimates, from pairwise bit counts, how likely two fingerprints agree on a set of bits."""

    def __init__(self, n: int, both: np.ndarray):
        n = max(n, 1)
        p, one = both / n, np.diag(both) / n
        cells = np.stack([p, one[:, None] - p, one[None, :] - p, 1 - one[:, None] - one[None, :] + p]).clip(1e-12, 1)
        alone = np.stack([one, 1 - one]).clip(1e-12, 1)
        self.one = np.log((alone**2).sum(axis=0))
        self.gain = np.log((cells**2).sum(axis=0)) - self.one[:, None] - self.one[None, :]  # agreement is likelier together
        product = np.stack([alone[0][:, None] * alone[0], alone[0][:, None] * alone[1], alone[1][:, None] * alone[0], alone[1][:, None] * alone[1]])
        self.known: dict = {}
        self.info = (cells * np.log(cells / product)).sum(axis=0)

    def parts(self, m: int, turn: int = 0) -> list[list[int]]:
        """m parts of about equal size; each grows from the bit with most mutual information by the bit most tied to it. Further turns weigh the ties
        at random, so that they group the bits in another way."""
        info, b = self.info, len(self.one)
        if turn:
            noise = np.random.default_rng(turn).random((b, b))
            info = info * (noise + noise.T)
        left, out = np.ones(b, bool), []
        for k in range(m):
            size, part = -(-int(left.sum()) // (m - k)), []
            tie = info[:, left].sum(axis=1) - np.diag(info)
            while len(part) < size:
                best = int(np.where(left, tie, -np.inf).argmax())
                tie = info[:, best].copy() if not part else tie + info[:, best]
                part.append(best)
                left[best] = False
            out.append(sorted(part))
        return out

    def log_p(self, bits: list[int]) -> float:
        """log P(agree on bits) along a maximum spanning tree of the pairwise gains."""
        total = float(self.one[bits].sum())
        if len(bits) > 1:
            gain, best = self.gain[np.ix_(bits, bits)], self.gain[bits[0], bits].copy()
            best[0], inside = -np.inf, [0]
            for _ in range(len(bits) - 1):
                j = int(best.argmax())
                total += max(0.0, float(best[j]))
                inside.append(j)
                best = np.maximum(best, gain[j])
                best[inside] = -np.inf
        return min(0.0, total)

    def weighed(self, m: int, turn: int) -> list[tuple[list[int], float]]:
        """``parts`` with the log chance to agree on each, computed once."""
        if (m, turn) not in self.known:
            self.known[m, turn] = [(p, self.log_p(p)) for p in self.parts(m, turn)]
        return self.known[m, turn]

    def cost(self, n: int, keys: list[list[int]]) -> float:
        return sum(n * n / 2 * np.exp(self.log_p(k)) for k in keys) + ROW_COST * n * len(keys)


def _keys(part: list[int], t: int) -> list[list[int]]:
    """The bits that are left when t of a part may differ, for each choice of the t."""
    return [[b for b in part if b not in out] for out in combinations(part, t)]


def _masks(keys: list[list[int]], bits: int) -> list[list[int]]:
    """Keys as signed 64-bit masks, one for each word of the fingerprint."""
    whole = [sum(1 << b for b in k) for k in keys]
    word = lambda m, k: (m >> 64 * k) & ((1 << 64) - 1)
    return [[w - (1 << 64) if (w := word(m, k)) >> 63 else w for k in range(bits // 64)] for m in whole]


def plan(n: int, both: np.ndarray, radius: int) -> list[list[int]]:
    """Masks such that any two fingerprints within ``radius`` bits agree under at least one of them.

    For m parts with thresholds that sum to radius - m + 1 (-1 leaves a part out), some part differs in no more bits
    than its threshold; a threshold t becomes one mask for each way to leave t bits of the part out. Parts of eight bits allow any radius under the
    number of bits; a larger one would link everything and is refused.
    """
    bits = len(both)
    if not 0 <= radius < bits:
        raise ValueError(f"a radius of 0 to {bits - 1} bits is needed, not {radius}")
    n = max(n, 1)  # without fingerprints all plans would cost nothing, those of thousands of keys, too
    agree, best = Agreement(n, both), (np.inf, [])
    for m in (*range(2, 9), bits // 8):
        table = []
        for part in agree.parts(m):
            row = [(0.0, [])]
            for t in range(len(part)):
                if math.comb(len(part), t) > MOST_KEYS or t > radius:
                    break
                row.append((agree.cost(n, keys := _keys(part, t)), keys))
            table.append(row)
        todo = {0: (0.0, [])}
        for row in table:
            new: dict = {}
            for had, (cost, keys) in todo.items():
                for t, (c, k) in enumerate(row, -1):
                    if had + t not in new or cost + c < new[had + t][0]:
                        new[had + t] = (cost + c, keys + k)
            todo = new
        if (found := todo.get(radius - m + 1)) and found[0] < best[0]:
            best = found
    if not best[1]:
        raise ValueError(f"no plan covers a radius of {radius} bits")
    return _masks(best[1], bits)


def flip(similarity: float) -> float:
    """How likely a bit differs between two texts of this Jaccard similarity: the angle of their shingle vectors over pi."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def likely_radius(bits: int, similarity: float, recall: float) -> int:
    """The least number of differing bits that this share of the pairs of this similarity does not exceed."""
    p, q, total = 1.0, flip(similarity), 0.0
    for d in range(bits + 1):
        p = math.exp(math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(max(q, 1e-300)) + (bits - d) * math.log1p(-q))
        total += p
        if total >= recall:
            return d
    return bits


def chance(masks: list[list[int]], q: float, trials: int = 4000) -> float:
    """The share of trials, each bit flipped with probability q, in which some mask holds no flipped bit."""
    flipped = np.packbits(np.random.default_rng(7).random((trials, 64 * len(masks[0]))) < q, axis=1, bitorder="little").view(np.int64)
    hit = np.zeros(trials, bool)
    for m in np.array(masks, np.int64):
        hit |= ~np.any(flipped & m, axis=1)
    return float(hit.mean())


def likely_plan(n: int, both: np.ndarray, similarity: float, recall: float) -> list[list[int]]:
    """Masks under at least one of which two texts of this similarity agree with probability ``recall``, at little cost. Parts of several groupings
    share bits, so their chances are not independent: the goal of ``_deal`` is raised until a simulation confirms the recall."""
    n = max(n, 1)
    agree, goal = Agreement(n, both), 1 - (1 - recall) * 0.7
    for _ in range(12):
        masks = _masks(_deal(n, agree, flip(similarity), goal), len(both))
        if chance(masks, flip(similarity)) >= recall:
            return masks
        goal = 1 - (1 - goal) * 0.6
    return masks


def _deal(n: int, agree: Agreement, q: float, recall: float) -> list[list[int]]:
    """Bits of the keys: for several widths of parts and several groupings of the bits a dynamic program deals thresholds -1 (left out), 0 or 1 so that the
    parts' chances to agree, taken as independent, add up to the recall at least cost."""
    bits, step, best = len(agree.one), 0.005, (np.inf, [])
    goal = math.ceil(-math.log(max(1 - recall, 1e-9)) / step)
    units = np.arange(goal + 1)
    fair = math.log2(max(2.0, n / (2 * ROW_COST)))  # where a key of evenly spread bits costs as much as its candidates
    for width in range(max(4, 2 * int(fair / 2 - 1)), min(bits, int(fair) + 7), 2):
        exact, one_off = (1 - q) ** width, width * q * (1 - q) ** (width - 1)
        turns = math.ceil(1.2 * goal * step / (bits // width) / -math.log1p(-exact))
        if turns > 200:
            break
        cost, back = np.where(units == 0, 0.0, np.inf), []
        for turn in range(turns):
            for part, p in agree.weighed(bits // width, turn):
                new, choice, origin = cost.copy(), np.full(goal + 1, -1), units.copy()
                prices = (n * n / 2 * math.exp(p) + ROW_COST * n, sum(n * n / 2 * math.exp(min(0.0, p - agree.one[b])) + ROW_COST * n for b in part))
                for t, (chance, c) in enumerate(zip((exact, exact + one_off), prices, strict=True)):
                    worth = min(goal, int(-math.log1p(-min(chance, 1 - 1e-9)) / step))
                    if not worth:
                        continue
                    came, source = np.full(goal + 1, np.inf), units - worth
                    came[worth:] = cost[: goal + 1 - worth] + c
                    source[goal] = goal - worth + int(cost[goal - worth :].argmin())  # more than enough is enough
                    came[goal] = cost[source[goal]] + c
                    better = came < new
                    new[better], choice[better], origin[better] = came[better], t, source[better]
                cost = new
                back.append((part, choice, origin))
        if cost[goal] < best[0]:
            at, keys = goal, []
            for part, choice, origin in reversed(back):
                if choice[at] >= 0:
                    keys += [k for t in range(choice[at] + 1) for k in _keys(part, t)][-math.comb(len(part), int(choice[at])) :]
                at = int(origin[at])
            best = (cost[goal], keys)
    if not best[1]:
        raise ValueError(f"no plan reaches a recall of {recall} where a bit differs with probability {q}")
    return best[1]


def _tiles(radius: int, words: int):
    """Links inside each tile: rows come sorted by (key, t1, t2); a tile compares block t1 with block t2. What leaves a tile is a spanning forest."""

    def links(side, fps, node, alone):
        order = np.argsort(side, kind="stable")
        fps, node, cut = fps[order], node[order], 0 if alone else int((side == 0).sum())
        i_s, j_s = [], []
        left, right, off = (fps, fps, 0) if alone else (fps[:cut], fps[cut:], cut)
        rows = max(1, AT_ONCE // max(1, len(right)))
        for at in range(0, len(left), rows):
            i, j = np.nonzero(np.bitwise_count(left[at : at + rows, None, 0] ^ right[None, :, 0]) <= radius)
            if words > 1:
                far = sum(np.bitwise_count(left[at + i, k] ^ right[j, k]).astype(np.int32) for k in range(words))
                i, j = i[far <= radius], j[far <= radius]
            if alone:
                i, j = i[at + i < j], j[at + i < j]
            # only a forest of what a slice links is kept, so that a block of copies costs no more than its nodes
            nodes, place = np.unique(np.concatenate([i + at, j + off]), return_inverse=True)
            lab = min_labels(len(nodes), place[: len(i)], place[len(i) :])
            own = lab != np.arange(len(nodes))
            i_s.append(nodes[own])
            j_s.append(nodes[lab[own]])
        lab = min_labels(len(fps), np.concatenate(i_s or [np.empty(0, int)]), np.concatenate(j_s or [np.empty(0, int)]))
        own = lab != np.arange(len(fps))
        return node[own], node[lab[own]]

    def run(batches):
        for c, bounds in runs(batches, ("key", "t1", "t2")):
            us, vs = [], []
            fps = np.stack([c[f"fp{k}"] for k in range(words)], axis=1).view(np.uint64)
            for i, j in bounds:
                if j - i > 1:
                    u, v = links(c["side"][i:j], fps[i:j], c["node"][i:j], c["t1"][i] == c["t2"][i])
                    us.append(u)
                    vs.append(v)
            u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def hamming_links(fps: DataFrame, radius: int, masks: list[list[int]] | None = None) -> DataFrame:
    """Links (u, v) between nodes of distinct fingerprints (fp0 .., node). Pairs that agree under a mask and lie within ``radius`` bits are linked; without
    ``masks`` the plan covers all pairs within the radius, and the transitive closure is that of all such pairs. A bucket of n fingerprints is cut into about
    sqrt(n / BLOCK) blocks; each task compares two blocks and emits a spanning forest, so no bucket is gathered whole and no list of pairs is made."""
    names = [c for c in fps.columns if c.startswith("fp")]
    masks = masks or plan(*bit_counts(fps), radius)
    key = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(w)) for c, w in zip(names, m, strict=True) if w]) for i, m in enumerate(masks)])
    keys = fps.select(*names, "node", F.explode(key).alias("key"))
    hot = keys.groupBy("key").count().where(F.col("count") > BLOCK)
    hot = hot.select("key", F.ceil(F.sqrt(F.col("count") / BLOCK)).cast("int").alias("blocks"))
    keys = keys.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64(*names, F.lit(3)), F.col("blocks"))).cast("int")
    keys = keys.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = keys.select("key", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), (F.col("own") > F.col("other")).cast("int").alias("side"), *names, "node")
    tiles = keys.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")
    return tiles.mapInArrow(_tiles(radius, len(names)), "u long, v long")


def _classes(fp: DataFrame, links) -> DataFrame:
    """``fp`` with its class: (root, a number without meaning). Equal fingerprints are one node, numbered once and written."""
    names = [c for c in fp.columns if c.startswith("fp")]
    nodes = written(fp.select(names).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = components(links(nodes), "u", "v").withColumnRenamed("node", "of")
    nodes = nodes.join(found, F.col("node") == F.col("of"), "left").select(*names, F.coalesce("component", "node").alias("root"))
    return fp.join(nodes, names)


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints within ``radius`` bits link, component = smallest doc_id reachable.

    Equal fingerprints are collapsed first, so groups of exact copies cost one row. Texts without words have fingerprint
    zero and link like any other. Rows that share a doc_id with different texts are told apart by their fingerprints; rows with a null doc_id link but name no
    component: it is null where no row of the class has an id. An empty table gives an empty result.
    """
    fp = written(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    classes = written(_classes(fp.select("doc_id", "fp0"), lambda nodes: hamming_links(nodes, radius)), "classes")
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return classes.join(least, "root").select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.95) -> DataFrame:
    """(doc_id, digest, root): documents in one class are linked, directly or over others, by 256-bit fingerprints of ``shingle``-word shingles that are as near
    as those of texts with this Jaccard similarity. Probing and verifying each find a pair of exactly that similarity with probability ``recall``, closer ones
    with more, equal fingerprints always; of pairs at 0.7, 0.6 and 0.5 about a half, 6 % and 0.3 % come within the radius."""
    fp = written(fingerprints(docs, shingle, 4), "fingerprints")

    def links(nodes):
        masks = likely_plan(*bit_counts(nodes), similarity, recall)
        return hamming_links(nodes, likely_radius(256, similarity, recall), masks)

    return _classes(fp, links).select("doc_id", "digest", "root")


def dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.95) -> DataFrame:
    """The documents that stay, all their columns: of each class of ``similar_classes`` the one with the smallest doc_id (null last), then the smallest text
    digest. Rows are told apart by id and text: of rows with both equal one stays, any of them; rows that share an id but not the text are documents of their own."""
    classes = written(similar_classes(docs, similarity, shingle, recall), "classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "digest")).alias("first"), F.count("*").alias("n"))
    # What goes is named by digest and id; a class of one text under one id needs no more than its repeats removed.
    rows = classes.groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies")).join(first, "root")
    stays = (F.col("first.digest") == F.col("digest")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    marked = rows.where(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), stays.alias("__stays"))
    kept = docs.withColumn("__d", F.md5(F.coalesce("text", F.lit(""))))
    kept = kept.join(marked, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__d") == F.col("__digest")), "left")
    single = kept.where("__stays is null").select(docs.columns)
    return single.unionByName(kept.where("__stays").dropDuplicates(["doc_id", "__d"]).select(docs.columns))
