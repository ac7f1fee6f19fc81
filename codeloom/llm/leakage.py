"""Evaluation texts leaking into training text, in whole or in pieces.

Texts become token sequences that letter case, width, spacing, line breaks,
punctuation, markup, comment signs and invisible characters cannot change: words,
or single characters in scripts without spaces. Windows slide over items and
documents; a window's fingerprint is the SimHash of its weighted shingles. There
are windows of two kinds: of the size of an item (the power of two that it holds),
which find whole copies with scattered changes, and of three tokens, the
shortest run that the verification counts. Items' fingerprints are indexed by blocks
of bits: by the pigeonhole principle two fingerprints within the radius agree in
at least one block, so looking up every block finds them all.

Texts with fewer windows equal to the items' than any item needs are passed over
first; that is exact, too. What item-sized windows suggest is verified, and so is every pair with as many
short windows as an accepted pair must share (`least_windows`, which follows from
the verification's own constants): the index loses nothing that the verification accepts. That is exact:
runs of equal tokens, single changed words bridged, are chained in the order of
both texts, and the weighted share of the item that they cover decides.

The items are a stated query set against all rows: they are read in blocks of
bounded size, and each block is matched against all documents.

Defined results: null and blank texts leak nothing; an item without tokens is
never found; repeated rows count once; of different texts under one id the
greatest counts; items with equal texts are all reported; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.rows import one_text_each, own_id, whole_id
from codeloom.sources.tables import Scratch

#: Tokens of the shortest run that the verification counts, and of the short windows.
RUN = 3
#: Bits in which fingerprints may differ, and the blocks that make finding all of them certain.
RADIUS, BLOCKS = 3, 4
BITS = 64 // BLOCKS
#: Least share of an item that makes a case; less than two fifths is none.
SHARE = 0.45
#: Least tokens of a piece (about a sentence), and how much of a piece has to be equal.
PIECE_WORDS, PIECE_CHARS, EQUAL = 8, 12, 0.8
#: Characters of item text that one block of items may hold.
ITEM_BLOCK = 4_000_000
UNSPACED = ("zh", "ja", "th", "lo", "km", "my")

_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}々ー]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}々ー])[\p{L}\p{M}\p{N}])+")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+")
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")
_ENTITY = regex.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w{2,8});")
_TAG = regex.compile(r"</?[A-Za-z][^<>\n]*>")


def tokens(s: str) -> list[str]:
    """The text's tokens without anything that copying may change."""
    if "&" in s:
        s = _ENTITY.sub(" ", s)
    if "<" in s:
        s = _TAG.sub(" ", s)
    if s.isascii():
        return _ASCII_TOKEN.findall(s.lower())
    s = _INVISIBLE.sub("", unicodedata.normalize("NFKC", s))
    return _TOKEN.findall(s.casefold())


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Tokens whose hashes a worker remembers; a bound on memory only.
REMEMBERED = 500_000


class _Known(dict):
    """Hashes of tokens by token."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


_known = _Known()


def _hashes(ts: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, ts), dtype=np.uint64, count=len(ts))


def _lanes(x: np.ndarray, kind: type) -> np.ndarray:
    """Bits of each hash as a row of 64 numbers, +1 or -1."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.view(np.int8) * 2 - 1).astype(kind)


class Sums:
    """Running sums of the hashes' bits, from which windows of any size up to `longest` are fingerprinted."""

    def __init__(self, h: np.ndarray, longest: int):
        self.n = len(h)
        # sums may wrap: what counts is their difference over a window, which fits
        kind = np.int16 if longest * 3 < 1 << 15 else np.int32
        with np.errstate(over="ignore"):
            pair = _mix(h[:-1] * _PRIME + h[1:]) if len(h) > 1 else np.zeros(0, dtype=np.uint64)
            zero = np.zeros((1, 64), dtype=kind)
            self.single = np.concatenate((zero, np.cumsum(_lanes(_mix(h), kind), axis=0, dtype=kind)))
            self.pair = np.concatenate((zero, np.cumsum(_lanes(pair, kind) * kind(2), axis=0, dtype=kind)))

    def fingerprints(self, window: int) -> np.ndarray:
        """SimHash of each window: its shingles are tokens and token pairs, a pair counting twice."""
        n = self.n - window + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        total = self.single[window : window + n] - self.single[:n]
        total += self.pair[window - 1 : window - 1 + n]
        total -= self.pair[:n]
        return np.packbits(total > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    return Sums(h, window).fingerprints(window)


def least_windows(weight: list[int], piece: int) -> int:
    """How many of an item's short windows an accepted document must hold.

    Pieces cover at least SHARE of the weight, so at least as many tokens as the
    heaviest that make it up, and at least EQUAL of a piece's tokens are equal. E equal
    tokens in r runs, each of RUN or more, hold at least r windows and at least
    E - (RUN - 1) * r; whatever r is, one of these is E / RUN or more.
    """
    need, tokens_, total = SHARE * sum(weight), 0, 0
    for w in sorted(weight, reverse=True):
        if total >= need:
            break
        total += w
        tokens_ += 1
    return max(1, math.floor(tokens_ * EQUAL / RUN))


class Index:
    """Fingerprints of the windows of some items, by blocks of bits, and the items' tokens."""

    def __init__(self, items: list[tuple[int, str | None, str]]):
        self.items = []
        self.least = []
        self.runs: dict[int, set[tuple[str, ...]]] = defaultdict(set)
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        for item_id, lang, text in items:
            ts = tokens(text or "")
            if not ts:
                continue
            wide = sum(len(t) == 1 and ord(t) > 0x0E00 for t in ts) * 2 > len(ts)
            chars = (lang or "").lower()[:2] in UNSPACED or wide
            k = len(self.items)
            weight = [len(t) for t in ts] if chars else [1] * len(ts)
            self.items.append((item_id, chars, ts, weight, sum(weight)))
            self.least.append(least_windows(weight, PIECE_CHARS if chars else PIECE_WORDS))
            short, sized = min(RUN, len(ts)), 1 << (len(ts).bit_length() - 1)
            self.runs[short].update(zip(*(ts[k:] for k in range(short))))
            sums = Sums(_hashes(ts), max(short, sized))
            for window in {short, sized}:
                p = sums.fingerprints(window)
                prints[window].append(p)
                owners[window].append(np.full(len(p), k, dtype=np.int64))
                places[window].append(np.arange(len(p), dtype=np.int64))
        self.tables = {}
        for window, ps in prints.items():
            p, o, at = np.concatenate(ps), np.concatenate(owners[window]), np.concatenate(places[window])
            blocks = []
            for b in range(BLOCKS):
                key = ((p >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                order = np.argsort(key, kind="stable")
                first = np.zeros((1 << BITS) + 1, dtype=np.int64)
                np.cumsum(np.bincount(key, minlength=1 << BITS), out=first[1:])
                blocks.append((order, first, np.diff(first)))
            self.tables[window] = (p, o, at, blocks)

    def may_hold(self, ts: list[str]) -> bool:
        """Whether a text has as many short windows equal to some item's as the item that needs the fewest: an accepted piece's windows stand at as many places of the text."""
        need = min(self.least, default=1)
        for g, known in self.runs.items():
            need -= sum(map(known.__contains__, zip(*(ts[k:] for k in range(g)))))
            if need <= 0:
                return True
        return False

    def _near(self, f: np.ndarray, whole: np.ndarray, p: np.ndarray, blocks: list) -> tuple[np.ndarray, np.ndarray]:
        """(places in `f`, places in `p`) of all fingerprints within the radius; a pair may come more than once."""
        at, which = [], []
        for b, (order, first, many) in enumerate(blocks):
            key = ((f >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            n = np.where(whole, many[key], 0)
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            x = np.repeat(hit, n)
            inside = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            y = order[first[key[x]] + inside]
            near = np.bitwise_count(f[x] ^ p[y]) <= RADIUS
            at.append(x[near])
            which.append(y[near])
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(at), np.concatenate(which)) if at else (none, none)

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs to verify; a document is the owner of a token hash."""
        sized: list[np.ndarray] = []
        found: list[np.ndarray] = []
        longest = max(self.tables, default=1)
        items, places = len(self.items), max((len(x[2]) for x in self.items), default=1)
        for start in range(0, len(h), STEP):
            # windows that begin in this stretch
            here, mine = h[start : start + STEP + longest - 1], owner[start : start + STEP + longest - 1]
            sums = Sums(here, longest)
            for window, (p, o, place, blocks) in self.tables.items():
                f = sums.fingerprints(window)[:STEP]
                if not len(f):
                    continue
                x, y = self._near(f, mine[: len(f)] == mine[window - 1 : window - 1 + len(f)], p, blocks)
                if not len(x):
                    continue
                pair = mine[x] * items + o[y]
                if window > RUN:
                    sized.append(np.unique(pair))
                else:
                    found.append(np.unique(pair * places + place[y]))
        if found:
            # distinct windows of the item that the document holds
            pairs, n = np.unique(np.unique(np.concatenate(found)) // places, return_counts=True)
            sized.append(pairs[n >= np.array(self.least)[pairs % items]])
        return {(int(x) // items, int(x) % items) for part in sized for x in part}


def grams(ts: list[str], g: int) -> dict[tuple[str, ...], list[int]]:
    """Places of each run of `g` tokens."""
    where: dict[tuple[str, ...], list[int]] = defaultdict(list)
    for j, t in enumerate(zip(*(ts[k:] for k in range(g)))):
        where[t].append(j)
    return where


def share(item: list[str], weight: list[int], total: int, doc: list[str], where: dict[tuple[str, ...], list[int]], piece: int) -> float:
    """Weighted share of an item's tokens that recurs in the document in the item's order, in pieces of at least `piece` tokens.

    Runs of at least RUN equal tokens are anchors (`where` has the document's places
    of that many tokens, or of as many as a shorter item has); runs are chained with
    both places growing. Inside a piece a gap of at most two tokens on either side
    is a changed word; a piece whose equal tokens are less than EQUAL of its span
    is none.
    """
    n, m = len(item), len(doc)
    g = min(RUN, n)
    # maximal runs of equal tokens, by their place in the item and then in the document
    runs: dict[int, list[tuple[int, int]]] = {}
    for i in range(n - g + 1):
        found = []
        for j in where.get(tuple(item[i : i + g]), ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            k = g
            while i + k < n and j + k < m and item[i + k] == doc[j + k]:
                k += 1
            found.append((j, k))
        if found:
            runs[i] = found
    if not runs:
        return 0.0
    # pieces: runs joined over small gaps, the longest that follows first
    used: set[tuple[int, int]] = set()
    good = []
    for i in sorted(runs):
        for j, k in runs[i]:
            if (i, j) in used:
                continue
            chain = [(i, j, k)]
            used.add((i, j))
            while True:
                a, b, c = chain[-1]
                best = None
                for a2 in range(a + c - 1, a + c + 3):
                    near = runs.get(a2, ())
                    y = bisect_left(near, (b + c - 1, 0))
                    while y < len(near) and near[y][0] <= b + c + 2:
                        b2, c2 = near[y]
                        over = max(0, a + c - a2, b + c - b2)
                        if (a2, b2) not in used and c2 - over >= 2 and (best is None or c2 > best[2]):
                            best = (a2, b2, c2)
                        y += 1
                if best is None:
                    break
                used.add(best[:2])
                chain.append(best)
            i1, j1 = chain[-1][0] + chain[-1][2], chain[-1][1] + chain[-1][2]
            equal = set()
            for a, _, c in chain:
                equal.update(range(a, a + c))
            span = max(i1 - i, j1 - j)
            if span >= min(piece, n) and len(equal) >= EQUAL * span:
                good.append((i, i1, j, j1, sum(weight[i:i1])))
    return _heaviest(good) / total


def _heaviest(good: list[tuple[int, int, int, int, int]]) -> int:
    """The weight of the heaviest chain of pieces that follow each other in both texts, an overlap of one token aside.

    Pieces are taken as they begin in the item; those that have ended there by
    then stand in a tree of greatest weights by where they end in the document.
    """
    if not good:
        return 0
    ends = sorted({p[3] for p in good})
    tree = [0] * (len(ends) + 1)
    begins = sorted(good)
    order = sorted(range(len(begins)), key=lambda x: begins[x][1])
    score = [0] * len(begins)
    done = 0
    for x, (i0, _, j0, _, v) in enumerate(begins):
        while done < len(order) and begins[order[done]][1] <= i0 + 1 and order[done] < x:
            y = order[done]
            k = bisect_left(ends, begins[y][3]) + 1
            while k <= len(ends):
                tree[k] = max(tree[k], score[y])
                k += k & -k
            done += 1
        top, k = 0, bisect_left(ends, j0 + 2)
        while k:
            top = max(top, tree[k])
            k -= k & -k
        score[x] = top + v
    return max(score)


#: Tokens that are fingerprinted at once, and those of a group of texts; a longer text is a group of its own.
STEP, GROUP = 50_000, 400_000


def _matched(texts: list[tuple[int, list[str]]], index: Index) -> Iterator[tuple[int, int, float]]:
    h = np.concatenate([_hashes(ts) for _, ts in texts])
    owner = np.repeat(np.arange(len(texts)), [len(ts) for _, ts in texts])
    places: dict[tuple[int, int], dict] = {}
    for d, k in sorted(index.candidates(h, owner)):
        doc_id, ts = texts[d]
        item_id, chars, item, weight, total = index.items[k]
        g = min(RUN, len(item))
        if (d, g) not in places:
            if (d, RUN) not in places:
                places.clear()  # the documents come in order
            places[d, g] = grams(ts, g)
        x = share(item, weight, total, ts, places[d, g], PIECE_CHARS if chars else PIECE_WORDS)
        if x >= SHARE:
            yield doc_id, item_id, x


def leaks(rows: Iterator[tuple[int, str]], index: Index) -> Iterator[tuple[int, int, float]]:
    """(document id, item id, share) of the items of which documents hold enough."""
    group: list[tuple[int, list[str]]] = []
    size = 0
    for doc_id, text in rows:
        ts = tokens(text) if text else []
        if not ts or not index.may_hold(ts):
            continue
        if group and size + len(ts) > GROUP:
            yield from _matched(group, index)
            group, size = [], 0
        group.append((doc_id, ts))
        size += len(ts)
    if group:
        yield from _matched(group, index)


def _items(items: DataFrame) -> Iterator[list[tuple[int, str | None, str]]]:
    """The items in blocks whose texts have at most ITEM_BLOCK characters (a longer item is a block of its own)."""
    one = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max(F.struct("text", "lang")).alias("v")).select("item_id", "v.lang", "v.text").orderBy("item_id")
    block, size = [], 0
    for r in one.toLocalIterator():
        if block and size + len(r["text"]) > ITEM_BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["lang"], r["text"]))
        size += len(r["text"])
    yield block


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of documents that hold enough of an item."""
    docs = one_text_each(documents, "doc_id", "text", Scratch(documents.sparkSession, "leakage")).select(whole_id("i").alias("doc_id"), F.col("s").alias("text")).where("text is not null and text <> ''")
    out = None
    for block in _items(items):
        shared = documents.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value)
            for b in batches:
                yield pd.DataFrame(list(leaks(zip(b["doc_id"], b["text"]), index)), columns=["doc_id", "item_id", "share"])

        part = docs.mapInPandas(match, "doc_id long, item_id long, share double")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("doc_id", own_id("doc_id"))
