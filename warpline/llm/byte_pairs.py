"""Token ids of whole texts by a public byte-level vocabulary of merges.

Texts are cut into pieces by the vocabulary's pattern. All distinct pieces of a stretch of rows stand in
one array of symbols with links to their neighbours, and a pair occurrence index holds, for each merge, all
positions of its pair in that array. Active merges are applied in ascending rank; each application
touches only the indexed positions, unlinks the right symbol, and enters the two pairs that arise in the
lists of their (higher) ranks. Pieces are merged once, whatever the number of texts that hold them.

Defined results: null and empty texts have an empty list; the strings of special tokens are ordinary text;
any Unicode text has ids, since every byte has one; texts are never cut.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("WARPLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
CHARACTERS_AT_ONCE = 8_000_000


@lru_cache(1)
def _pattern() -> re.Pattern:
    """The vocabulary's pattern with the standard library's classes: letters are word characters that are no numbers."""
    other = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    runs = [[x for _, x in g] for _, g in groupby(enumerate(other), lambda p: p[1] - p[0])]
    more = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)
    # the standard library's \s also holds the four information separators, which aren't white space in Unicode
    space, apart = r"[^\S\x1c-\x1f]", r"\x1c-\x1f"
    letter, number = rf"[^\W\d_{more}]", rf"[\d{more}]"
    sign = rf"(?:[^\w\s]|[_{apart}])"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{sign}+|{space}+(?![\S{apart}])|{space}+")


def pieces(text: str) -> list[str]:
    return _pattern().findall(text)


class Merges:
    """Ids of bytes and, for each pair of ids, the id that it merges to; ids of merges ascend with their rank."""

    def __init__(self, path: str = VOCABULARY) -> None:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocabulary = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.of_byte = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        self.size = len(vocabulary)
        self.of_pair: dict[int, int] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.of_pair[vocabulary[a] * self.size + vocabulary[b]] = vocabulary[a + b]
        self.parts = {v: divmod(k, self.size) for k, v in self.of_pair.items()}


def encoded(words: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each)"""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(b) for b in raw], np.int64)
    symbols = merges.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    n, size, of_pair = len(symbols), merges.size, merges.of_pair
    if not n:
        return symbols, lengths
    word = np.repeat(np.arange(len(words)), lengths)
    inside = np.flatnonzero(word[1:] == word[:-1])
    # the index of the first pairs: each distinct pair's rank is looked up once, its positions stand in ascending order
    codes = symbols[inside] * size + symbols[inside + 1]
    distinct, which = np.unique(codes, return_inverse=True)
    ids = np.array([of_pair.get(int(c), -1) for c in distinct], np.int64)[which]
    known = ids >= 0
    order = np.argsort(ids[known], kind="stable")
    at, ids = inside[known][order], ids[known][order]
    index: dict[int, list[int]] = {}
    cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
    for c, e in zip(cuts, [*cuts[1:], len(ids)], strict=True) if len(ids) else ():
        index[int(ids[c])] = at[c:e].tolist()
    s = symbols.tolist()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for first, length in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist(), strict=True):
        if length:
            before[first] = -1
            after[first + length - 1] = -1
    get, parts = of_pair.get, merges.parts
    ranks = sorted(index)
    waiting = set(ranks)
    import heapq

    while ranks:
        merged = heapq.heappop(ranks)
        places = index.pop(merged)
        waiting.discard(merged)
        left, right = parts[merged]
        places.sort()
        for p in places:
            if s[p] != left or (q := after[p]) < 0 or s[q] != right:
                continue
            s[p], s[q] = merged, -1
            follow = after[p] = after[q]
            if follow >= 0:
                before[follow] = p
                if (new := get(merged * size + s[follow])) is not None:
                    if new in waiting:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        waiting.add(new)
                        heapq.heappush(ranks, new)
            if (ahead := before[p]) >= 0 and (new := get(s[ahead] * size + merged)) is not None:
                if new in waiting:
                    index[new].append(ahead)
                else:
                    index[new] = [ahead]
                    waiting.add(new)
                    heapq.heappush(ranks, new)
    s = np.array(s, np.int64)
    live = s >= 0
    return s[live], np.bincount(word[live], minlength=len(words))


def _encode_batch(texts: list[str | None], merges: Merges) -> pa.ListArray:
    seen: dict[str, int] = {}
    number = seen.setdefault
    rows, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = pieces(t)
            rows.append(np.fromiter((number(w, len(seen)) for w in found), np.int32, len(found)))
            counts[i] = len(found)
    ids, sizes = encoded(list(seen), merges)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    n = sizes[words]
    ends = np.cumsum(n)
    flat = ids[np.repeat(starts[words] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
    if bounds[-1] >= 2**31:
        raise ValueError("a batch has over 2**31 ids: lower CHARACTERS_AT_ONCE")
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): no shuffle; rows are gathered to stretches of ``CHARACTERS_AT_ONCE`` and encoded together."""
    shared = documents.sparkSession.sparkContext.broadcast(Merges(vocabulary))  # of the vocabulary's fixed size

    def run(batches):
        keys, texts, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), _encode_batch(texts, shared.value)], names=[key, "ids"])

        for b in batches:
            lengths = [len(t) if t else 0 for t in b.column(1).to_pylist()]
            first = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= CHARACTERS_AT_ONCE:
                    keys.append(b.column(0).slice(first, i + 1 - first))
                    texts += b.column(1).slice(first, i + 1 - first).to_pylist()
                    yield flush()
                    keys, texts, size, first = [], [], 0, i + 1
            if first < b.num_rows:
                keys.append(b.column(0).slice(first))
                texts += b.column(1).slice(first).to_pylist()
        if keys:
            yield flush()

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
