"""Exact BPE by dynamic programming over prefixes, and decoding.

Every prefix of a word has one last token in its correct encoding. An automaton over the vocabulary lists, longest first, the tokens that
end at a position; the first one that is compatible with the last token of the prefix before it is kept. Two
tokens are compatible if BPE, given their joined text, would not merge across the seam. Following the kept tokens back from the end of the
word gives its ids. All distinct words of a batch advance together, one position at a time, in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

# The steps of the tokenizer file that ``words_of`` carries out; another file is refused.
NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
SPLITTER = [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)]
END = 256  # the symbol after a word's last byte
#: Words kept with their ids in a worker; longer words are encoded in groups of their own; slots of the pair cache.
CACHE, CHUNK, SLOTS = 100_000, 20_000, 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _char_class(first: str, top: int) -> str:
    """The characters up to ``top`` whose general category starts with ``first``, as ranges of a character class."""
    points = [c for c in range(top + 1) if unicodedata.category(chr(c))[0] == first]
    breaks = [0, *(i for i in range(1, len(points)) if points[i] != points[i - 1] + 1), len(points)]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip(breaks, breaks[1:], strict=False))


SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=3)
def _pattern(top: int) -> re.Pattern:
    """For texts whose characters are at most ``top``: a class within the basic plane is one table look-up."""
    letter, number, space = ("a-zA-Z", "0-9", "\\t-\\r ") if top < 128 else (_char_class("L", top), _char_class("N", top), SPACE)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


def words_of(text: str) -> list[str]:
    """Normalise (NFC, lower case by single characters) and split into the tokenizer's words; white space goes."""
    if text.isascii():
        return _pattern(127).findall(text.lower())
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return _pattern(0xFFFF if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else sys.maxunicode).findall(text)


def _steps(spec: dict | None) -> list[tuple]:
    """Kind and pattern of each step of a normalizer or splitter."""
    steps = (spec or {}).get("normalizers") or (spec or {}).get("pretokenizers") or [spec or {}]
    return [(s.get("type"), (s.get("pattern") or {}).get("Regex")) for s in steps]


class WordBpe:
    """Encoder for a tokenizers file whose model is BPE with an end-of-word suffix over the byte alphabet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (_steps(spec["normalizer"]), _steps(spec["pre_tokenizer"])) != (NORMALIZER, SPLITTER) or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE":
            raise ValueError(f"{path}: words_of and decode follow another normalizer, splitter or decoder")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.text = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max(vocab.values()) + 1
        #: Ids by the rank of the merge that makes them, so that a smaller number is merged first; single symbols come first.
        made = {a + b: r for r, (a, b) in reversed(list(enumerate(merges)))}
        order = sorted(vocab, key=lambda t: (made.get(t, -1), vocab[t]))
        self.id_of = np.array([vocab[t] for t in order])
        rank = {t: r for r, t in enumerate(order)}
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = {}
        for a, b in merges:
            pairs.setdefault((rank[a], rank[b]), rank[a + b])
        for t, r in made.items():
            a, b = merges[r]
            self.left[rank[t]], self.right[rank[t]] = rank[a], rank[b]
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.size, self.pair_key, self.pair_to = size, keys[by], np.array(list(pairs.values()))[by]
        self._automaton({r: [to_byte[c] for c in t.removesuffix(suffix)] + [END] * t.endswith(suffix) for t, r in rank.items()})
        self.slot_key, self.slot_ok = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.cache: dict[str, list[int]] = {}
        self.digits = {i: str(i) for i in self.text}

    def _automaton(self, spelled: dict[int, list[int]]) -> None:
        """Trie of the tokens with suffix links: ``go`` leads from the longest known suffix of a prefix to that of the next, ``stop`` to that of
        the finished word; ``token`` is the longest token that ends in a state, ``then`` the state of the next shorter one (0: none). States behind the
        end of a word have no way on and come last, so that the table stays small."""
        child: dict[int, int] = {}
        plain = 1
        for symbols in spelled.values():
            s = 0
            for c in symbols:
                if c != END:
                    s = child.setdefault(s << 9 | c, plain)
                    plain += s == plain
        n = plain
        token, depth = [-1] * plain, [0] * plain
        for r, symbols in spelled.items():
            s = 0
            for d, c in enumerate(symbols, 1):
                s = child.setdefault(s << 9 | c, n)
                if s == n:
                    n += 1
                    token.append(-1)
                    depth.append(d)
                depth[s] = d
            token[s] = r
        edges = np.array([(k >> 9, k & 511, v) for k, v in child.items()], np.int64)
        self.plain, self.token, self.width = plain, np.array(token, np.int32), np.array(depth, np.int32)
        inner = np.unique(np.append(0, edges[edges[:, 1] < END, 0]))  # a state without children goes on as its suffix does and needs no row
        self.row, self.go = np.full(plain, -1, np.int32), np.zeros((len(inner), END), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.stop, link = np.zeros(plain, np.int32), np.zeros(n, np.int32)
        level = self.width[edges[:, 2]]
        for d in range(1, int(level.max(initial=0)) + 1):
            s, c, k = edges[level == d].T
            byte = c < END
            if d > 1:
                link[k[byte]] = self.go[self.row[link[s[byte]]], c[byte]]
            link[k[~byte]] = self.stop[link[s[~byte]]]
            self.go[self.row[s[byte]], c[byte]] = k[byte]
            self.stop[s[~byte]] = k[~byte]
            # the states of this level start from the ways of their suffixes; their own ways are set with the next level
            new = k[byte]
            has = self.row[new] >= 0
            self.go[self.row[new[has]]] = self.go[self.row[link[new[has]]]]
            self.row[new[~has]] = self.row[link[new[~has]]]
            self.stop[new] = self.stop[link[new]]
        self.then = np.zeros(n, np.int32)
        for s in np.argsort(self.width, kind="stable")[1:]:
            f = link[s]
            self.then[s] = f if self.token[f] >= 0 else self.then[f]

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a then b stay apart: undo the later merge of the two again and again; across each seam that comes up, the pair
        must not have been merged earlier than the merge just undone."""
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 12) & (SLOTS - 1)
        ok = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            uniq, back = np.unique(key[miss], return_inverse=True)
            found = self._test(uniq // self.size, uniq % self.size)
            ok[miss] = found[back]
            at = slot[miss]
            self.slot_key[at], self.slot_ok[at] = key[miss], ok[miss]
            clash = self.slot_key[at] != key[miss]  # two pairs of one slot: the last one written stays
            self.slot_ok[at[clash]] = found[np.searchsorted(uniq, self.slot_key[at[clash]])]
        return ok

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(live):
            key = a * self.size + b
            pos = np.searchsorted(self.pair_key, key).clip(0, len(self.pair_key) - 1)
            bad = (self.pair_key[pos] == key) & (self.pair_to[pos] < limit)
            ok[live[bad]] = False
            whole_a, whole_b = self.right[a] == a, self.left[b] == b
            first = ~whole_a & (whole_b | (a > b))  # the later merge is undone; a merge of equal rank on the left came first
            done = bad | (whole_a & whole_b)
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            keep = ~done
            live, a, b, limit = live[keep], a[keep], b[keep], limit[keep]
        return ok

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words, none empty, in one pass over positions; words are padded to the longest."""
        n, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lens, kind="stable")
        lens, top = lens[order], int(lens.max())
        grid = np.zeros((n, top), np.uint8)
        for row, i in enumerate(order.tolist()):
            grid[row, : lens[row]] = np.frombuffer(words[i], np.uint8)
        last, state = np.full((top + 1, n), -1, np.int32), np.zeros(n, np.int32)
        for e in range(1, top + 1):
            live = int(np.searchsorted(-lens, -e, "right"))  # words with at least e bytes
            state = self.go[self.row[state[:live]], grid[:live, e - 1]]
            ends = lens[:live] == e
            cand = np.where(ends, self.stop[state], state)
            cand = np.where(self.token[cand] >= 0, cand, self.then[cand])
            todo = np.arange(live)
            while len(todo):
                s = cand[todo]
                tok, begin = self.token[s].astype(np.int64), e - self.width[s] + ends[todo]
                before = last[begin, todo]
                # a token for the inside of a word can't end it, and the other way round: END is part of the spelling
                fits = (begin == 0) | ((before >= 0) & self._compatible(np.maximum(before, 0).astype(np.int64), tok))
                last[e, todo[fits]] = tok[fits]
                cand[todo] = self.then[s]
                todo = todo[~fits]
                todo = todo[cand[todo] > 0]
        out: list[list[int]] = [[] for _ in range(n)]
        at, rows = lens.copy(), np.arange(n)
        while len(rows):
            tok = last[at[rows], rows]
            if (tok < 0).any():
                raise ValueError("the vocabulary has no token for some byte")
            width = self.token_bytes[tok]
            for r, t in zip(rows.tolist(), self.id_of[tok].tolist(), strict=True):
                out[order[r]].append(t)
            at[rows] -= width
            rows = rows[at[rows] > 0]
        return [x[::-1] for x in out]

    @property
    def token_bytes(self) -> np.ndarray:
        if not hasattr(self, "_bytes"):
            self._bytes = np.zeros(self.size, np.int64)
            has = np.flatnonzero(self.token >= 0)
            self._bytes[self.token[has]] = self.width[has] - (has >= self.plain)
        return self._bytes

    def learn(self, words: set[str]) -> None:
        """Put words and their ids into the cache."""
        new = sorted((w for w in words if w not in self.cache), key=len)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = sorted(words, key=len)
        at = 0
        while at < len(new):
            stop = min(len(new), at + CHUNK)
            while stop - at > 1 and (stop - at) * len(new[stop - 1]) > 40 * CHUNK:
                stop = at + (stop - at) // 2
            part = new[at:stop]
            for w, ids in zip(part, self._encode([w.encode("utf-8") for w in part]), strict=True):
                self.cache[w] = ids
            at = stop

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split, out = [], []
        for t in texts:
            if marks and any(m in t for m in self.special):
                parts = marks.split(t)
                split.append([w for i, p in enumerate(parts) for w in ([p] if i % 2 else words_of(p))])
            else:
                split.append(words_of(t))
        self.learn({w for ws in split for w in ws} - self.special.keys())
        extra = {m: [i] for m, i in self.special.items()}
        for ws in split:
            try:
                got = list(map(self.cache.__getitem__, ws))
            except KeyError:
                got = [extra.get(w) or self.cache[w] for w in ws]
            out.append(list(chain.from_iterable(got)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids joined by blanks, special ones included; unknown ids are passed over."""
        try:
            return " ".join(map(self.text.__getitem__, ids))
        except KeyError:
            return " ".join(self.text[i] for i in ids if i in self.text)


def encode(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True, decoded: bool = False) -> DataFrame:
    """``docs`` with n_tokens and token_ids (array), with ``decoded`` also what the ids decode to; with_ids=False gives ids_sha256 and decoded_sha256 instead.

    ``path`` must name the vocabulary file on every executor. Whole texts are encoded; a null text counts as empty: no ids, decoded "". The special tokens'
    strings in a text become their ids. Old columns of these names are replaced; repeated rows get repeated results.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
    new = {"n_tokens": "bigint"} | ({"token_ids": "array<int>"} if with_ids else {"ids_sha256": "string", "decoded_sha256": "string"}) | ({"decoded": "string"} if decoded else {})

    def run(batches):
        bpe = WordBpe(path)  # for this task only: a worker that goes on to other work keeps no tables
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                got = bpe.encode([t or "" for t in b.column(b.schema.names.index(text_col)).to_pylist()])
                cols = {"n_tokens": pa.array(list(map(len, got)), pa.int64())}
                if with_ids:
                    cols |= {"token_ids": pa.array(got, pa.list_(pa.int32()))}
                else:
                    cols |= {"ids_sha256": pa.array([sha(" ".join(map(bpe.digits.__getitem__, g))) for g in got]), "decoded_sha256": pa.array([sha(bpe.decode(g)) for g in got])}
                if decoded:
                    cols |= {"decoded": pa.array([bpe.decode(g) for g in got])}
                yield with_columns(b, cols)

    kept = docs.select([c for c in docs.columns if c not in new])
    schema = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes] + [f"{c} {t}" for c, t in new.items()])
    return kept.mapInArrow(run, schema)
