"""Documents that hold held-out passages, whole or in part, by greedy string tiling.

Texts become tokens: Unicode forms, case, accents, markup, punctuation and line breaks fall away, signs of
scripts without blanks are tokens of their own. Against items in a language every number is one token N
(as in masked corpora), against items of numbers it counts by itself. Rolling Karp-Rabin hashes of all
windows of ``SEED`` tokens (``SEED_SIGNS`` within such scripts) are joined with those of the items; only
places with shared seeds are looked at further. Within a place (seeds no more than ``APART`` tokens apart),
the longest match between item and document is marked, then the longest among what is left, down to a seed's length,
so moved passages are found piece by piece. The tiles that follow each other in the item's order are
chained, gaps of at most ``GAP`` tokens of the item between neighbours of the chain, and ``END`` tokens before its first
and after its last tile, are filled by what they have in common in order with the document's tokens there (changed
words break tiles), and a document holds an item when the chain covers ``COVERAGE`` of its tokens.

Seeds that many items share or that one text repeats don't cost more than they can bring: documents and items meet
first by distinct seeds. A pair is dropped where even the most that a chain could cover, by a proven bound (see
``most_covered``), is too little; only the others' hits are laid out, ``HITS_AT_ONCE`` at a time, and of equal matches no
more than can be of use are tiled.

The items are the stated query set. They are worked through in blocks of ``ITEMS_AT_ONCE``, each of which is indexed and
sent to the executors; all documents stream past ``BLOCKS_AT_ONCE`` blocks in one pass, so a text is told into tokens once
for so many. Documents aren't shuffled.

Defined results: null or empty documents hold nothing; an item of fewer tokens than a seed is found if all
its tokens stand together; repeated items give a row each; a document that is read twice gives its rows
once.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, SEED_SIGNS, APART, COVERAGE = 3, 5, 120, 0.42
GAP, END, END_AROUND = 12, 6, 10
ITEMS_AT_ONCE, BLOCKS_AT_ONCE = 20_000, 4
TOKENS_AT_ONCE = 400_000
HITS_AT_ONCE = 2_000_000
_SIGN = "぀-ヿ㐀-鿿豈-﫿"
_TOKEN = re.compile(rf"[{_SIGN}]|[^\W_{_SIGN}]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&[a-z]{2,6};")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_BASE = np.uint64(1_000_003)
_ANY_NUMBER, _UNKNOWN = 1, 0


def plain(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = unicodedata.normalize("NFC", text)
    text = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    return (_BROKEN.sub("", text) if "-" in text else text).casefold()


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(plain(text))


class Items:
    """The seeds of a block of items: sorted hashes, each with its item and place."""

    def __init__(self, rows: list[tuple[int, str | None]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.number: list[int] = []
        self.ids: list[int] = []
        self.texts: list[np.ndarray] = []
        self.masked: list[bool] = []
        self.seed: list[int] = []
        words = [(i, tokens(t or "")) for i, t in rows]
        for i, w in words:
            if not w:
                continue
            letters = sum(not x.isdecimal() for x in w)
            masked = letters * 2 > len(w)
            own = [_ANY_NUMBER if masked and (x.isdecimal() or x == "n") else self.vocabulary.setdefault(x, len(self.vocabulary) + 2) for x in w]
            signs = sum(len(x) == 1 and bool(re.match(f"[{_SIGN}]", x)) for x in w)
            self.ids.append(i)
            self.texts.append(np.array(own, np.int64))
            self.masked.append(masked)
            self.seed.append(min(len(w), SEED_SIGNS if signs * 2 > len(w) else SEED))
        self.is_number = np.zeros(len(self.vocabulary) + 2, bool)
        for x, k in self.vocabulary.items():
            self.is_number[k] = x.isdecimal()
        # what may stand for N: any number and the letter itself
        self.as_mask = self.is_number.copy()
        self.as_mask[_ANY_NUMBER] = True
        if "n" in self.vocabulary:
            self.as_mask[self.vocabulary["n"]] = True
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.concatenate(self.texts) if self.texts else np.zeros(0, np.int64)
        self.tables: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        grouped: dict[tuple[int, bool], list] = defaultdict(list)
        for k, text in enumerate(self.texts):
            h = hashes(text, self.seed[k])
            grouped[self.seed[k], self.masked[k]].append((h, np.full(len(h), k), np.arange(len(h))))
        for key, parts in grouped.items():
            h, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.tables[key] = h[order], item[order], place[order]

    def coded(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w) or (_ANY_NUMBER if w.isdecimal() or w == "n" else _UNKNOWN) for w in words), np.int64, len(words))


def hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Rolling Karp-Rabin hashes of all windows of n tokens."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * _BASE + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
        return h * np.uint64(0x9E3779B97F4A7C15)


def tiles(doc_at: np.ndarray, item_at: np.ndarray, seed: int, length: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the matches seeded at (doc_at, item_at): (item place, document place, length), not overlapping in either."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(d - i) != 0) | (np.diff(d) != 1)])
    n, a, b = np.diff(np.r_[cut, len(d)]) + seed - 1, i[cut], d[cut]
    # equal matches are tried from the first on; the tiles, which take at most the item's tokens, block fewer than these
    most = 2 * length // seed + 2
    if len(n) > most:
        order = np.lexsort((b, a, n))
        new = np.r_[True, (np.diff(n[order]) != 0) | (np.diff(a[order]) != 0)]
        first = np.flatnonzero(new)
        use = order[np.arange(len(order)) - first[np.cumsum(new) - 1] < most]
        n, a, b = n[use], a[use], b[use]
    heap = list(zip((-n).tolist(), a.tolist(), b.tolist(), strict=True))
    heapq.heapify(heap)
    in_item, in_doc, out = bytearray(length), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if not in_item[a + k] and b + k not in in_doc]
        if len(free) == -n:
            out.append((a, b, -n))
            for k in range(-n):
                in_item[a + k] = 1
                in_doc.add(b + k)
            continue
        start = None
        for k in [*free, None]:
            if start is not None and (k is None or k != last + 1):  # noqa: F821
                if last + 1 - start >= seed:
                    heapq.heappush(heap, (-(last + 1 - start), a + start, b + start))
                start = k
            elif start is None:
                start = k
            last = k
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    row = np.zeros(len(y) + 1, np.int64)
    for a in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == a, row[:-1] + 1, 0)))
    return int(row[-1])


def chained(found: list[tuple[int, int, int]], item: np.ndarray, doc: np.ndarray) -> int:
    """The most tokens of the item that stand in its order: tiles in ascending order of both, and what their gaps share."""
    found = sorted(found, key=lambda t: (t[1], t[0]))
    a, b, n = (np.array(c, np.int64) for c in zip(*found, strict=True))
    best = n.copy()
    back = np.full(len(n), -1)
    for k in range(1, len(n)):
        fits = np.flatnonzero((a[:k] + n[:k] <= a[k]) & (b[:k] + n[:k] <= b[k]) & (b[k] - b[:k] - n[:k] <= APART))
        if len(fits):
            j = fits[np.argmax(best[fits])]
            best[k], back[k] = best[j] + n[k], j
    k = int(np.argmax(best))
    total = int(best[k])
    first = k
    while back[k] >= 0:
        j = back[k]
        x, y = item[a[j] + n[j] : a[k]], doc[b[j] + n[j] : b[k]]
        if 0 < len(x) <= GAP and 0 < len(y) <= 2 * len(x) + 6:
            total += _common(x, y)
        k = j
    # what stands right before the chain and right after it
    for x, y in ((item[max(0, a[k] - END) : a[k]], doc[max(0, b[k] - END_AROUND) : b[k]]), (item[a[first] + n[first] :][:END], doc[b[first] + n[first] :][:END_AROUND])):
        total += _common(x, y) if len(x) and len(y) else 0
    return total


def most_covered(group: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The most tokens that a chain can cover, of each group of distinct seed places (sorted by group, place).

    Tiles lie within the seeds' windows. A gap that is filled with other tokens lies between two stretches of windows, no
    two filled gaps share such a space, and none is longer than ``GAP``; ``END`` more can follow on either side.
    """
    new = np.r_[True, np.diff(group) != 0]
    apart = np.r_[0, np.diff(place)]
    within = np.where(new, seed, np.minimum(apart, seed)) + np.where(new, 2 * END, np.clip(apart - seed, 0, GAP))
    return np.bincount(np.cumsum(new) - 1, within).astype(np.int64)


def _laid_out(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... of each row, n of them."""
    ends = np.cumsum(n)
    return np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _stretches(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of the stretches of equal values."""
    first = np.flatnonzero(np.r_[np.ones(min(1, len(sorted_values)), bool), np.diff(sorted_values) != 0])
    return sorted_values[first], first, np.r_[first[1:], len(sorted_values)][: len(first)]


def _possible(items: Items, docs: np.ndarray, h: np.ndarray, stream: np.ndarray, start: np.ndarray, lengths: np.ndarray, key: tuple[int, bool]) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of the pairs that may be a case: by their distinct seeds, and by the tokens that they share at all."""
    table, item_of, place_of = items.tables[key]
    order = np.lexsort((h, docs))
    once = order[np.r_[True, (np.diff(docs[order]) != 0) | (h[order][1:] != h[order][:-1])]]
    lo, hi = np.searchsorted(table, h[once], "left"), np.searchsorted(table, h[once], "right")
    at = _laid_out(lo, hi - lo)
    d, k, p = np.repeat(docs[once], hi - lo), item_of[at], place_of[at]
    order = np.lexsort((p, k, d))
    d, k, p = d[order], k[order], p[order]
    new = np.r_[True, (np.diff(d) != 0) | (np.diff(k) != 0)]
    covered = most_covered(np.cumsum(new), p, key[0])
    d, k = d[new], k[new]
    wanted = np.ceil(COVERAGE * items.lengths[k] - 1e-9)
    d, k = d[covered >= wanted], k[covered >= wanted]
    keep = np.zeros(len(d), bool)
    there = np.zeros(len(items.is_number), bool)
    for doc, first, last in zip(*_stretches(d), strict=True):
        own, of = stream[start[doc] : start[doc] + lengths[doc]], k[first:last]
        there[own] = True
        there[_UNKNOWN] = False
        tokens_at = _laid_out(items.starts[of], items.lengths[of])
        shared = np.add.reduceat(there[items.joined[tokens_at]].astype(np.int64), np.r_[0, np.cumsum(items.lengths[of])[:-1]])
        keep[first:last] = shared >= np.ceil(COVERAGE * items.lengths[of] - 1e-9)
        there[own] = False
    return d[keep], k[keep]


def held_items(texts: list[list[str]], items: Items) -> list[tuple[int, int]]:
    """(number of text, number of item) of the items that the texts hold, for texts given as tokens."""
    coded = [items.coded(w) for w in texts]
    lengths = np.array([len(c) for c in coded], np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    ids = np.concatenate([np.r_[c, _UNKNOWN] for c in coded]) if coded else np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(len(coded)), lengths + 1)
    masked_ids = np.where(items.as_mask[ids], _ANY_NUMBER, ids)
    out: set[tuple[int, int]] = set()
    for (seed, masked), (table, item_of, place_of) in items.tables.items():
        stream = masked_ids if masked else ids
        if len(stream) < seed:
            continue
        known = stream != _UNKNOWN
        all_known = known[: len(stream) - seed + 1].copy()
        for k in range(1, seed):
            all_known &= known[k : len(stream) - seed + 1 + k]
        at = np.flatnonzero(all_known)
        h = hashes(stream, seed)[at]
        lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
        at, h, lo, n = at[hi > lo], h[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        if not len(at):
            continue
        d, k = _possible(items, doc_of[at], h, stream, start, lengths, (seed, masked))
        pairs = np.sort(d * len(items.ids) + k)
        if not len(pairs):
            continue
        live = np.isin(doc_of[at], d)
        at, lo, n = at[live], lo[live], n[live]
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE)) + 1
        for part in np.split(np.arange(len(at)), cut):
            hit = _laid_out(lo[part], n[part])
            where = np.repeat(at[part], n[part])
            pair = doc_of[where] * len(items.ids) + item_of[hit]
            i = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            use = pairs[i] == pair
            hits.append((pair[use], where[use], place_of[hit[use]]))
        pair, where, place = (np.concatenate(c) for c in zip(*hits, strict=True))
        # places: seeds of one item in one document, no more than APART apart
        order = np.lexsort((where, pair))
        pair, where, place = pair[order], where[order], place[order]
        new = np.r_[True, (np.diff(pair) != 0) | (np.diff(where) > APART)]
        spot = np.cumsum(new) - 1
        by_place = np.lexsort((place, spot))
        s, p = spot[by_place], place[by_place]
        once = np.r_[True, (np.diff(s) != 0) | (np.diff(p) != 0)]
        most = most_covered(s[once], p[once], seed)
        cut = np.flatnonzero(new)
        doc, item = np.divmod(pair[cut], len(items.ids))
        able = most >= np.ceil(COVERAGE * items.lengths[item] - 1e-9)
        ends = np.r_[cut[1:], len(where)]
        for c, e, i, d in zip(cut[able].tolist(), ends[able].tolist(), item[able].tolist(), doc[able].tolist(), strict=True):
            if (d, i) in out:
                continue
            w, p = where[c:e], place[c:e]
            text = items.texts[i]
            covered = tiles(w, p, seed, len(text))
            low = max(0, int(w.min()) - 16)
            local = stream[low : int(w.max()) + seed + 16]
            if chained([(a, b - low, n) for a, b, n in covered], text, local) >= COVERAGE * len(text):
                out.add((d, i))
    return sorted(out)


def leaks(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id) of the items that documents hold."""
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col(text).alias("t")).distinct()
    total = wanted.count()
    blocks = max(1, -(-total // ITEMS_AT_ONCE))
    part = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    passes = []
    send = documents.sparkSession.sparkContext.broadcast
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        # each is a bounded block of items
        indexes = [send(Items([(r[0], r[1]) for r in wanted.where(part == k).collect()])) for k in range(first, min(first + BLOCKS_AT_ONCE, blocks))]

        def run(batches, indexes=indexes):
            keys, words, size = [], [], 0

            def flush():
                pairs = [(keys[d], index.value.ids[i]) for index in indexes for d, i in held_items(words, index.value)]
                return pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

            for b in batches:
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t:
                        keys.append(key)
                        words.append(tokens(t))
                        size += len(words[-1])
                    if size >= TOKENS_AT_ONCE:
                        yield flush()
                        keys, words, size = [], [], 0
            if keys:
                yield flush()

        passes.append(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, passes).distinct()
