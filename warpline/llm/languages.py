"""Languages of documents and of their lines, by a convolutional network over bytes.

The network reads fixed windows of ``WINDOW`` bytes: filters of the widths ``WIDTHS`` over one-hot bytes,
rectified, max-pooled over the window, and a softmax layer. It is trained here, in numpy: first on sentences
of known language, then again with lines of documents whose label names the language that the first network
gives them, from at most ``LINES`` sentences and lines a language, ``DOCUMENTS`` documents and ``LINES_OF_ONE`` lines of
each, all picked by a hash, so the same every time. These bounds hold for training only; every line of every document is classified.

Before that, lines without a language (code, config, log, numbers, markup) are told by their form: too few of
their letters stand in plain words, or too many signs of code among the words. A line's language is that
of the mean of its windows' log probabilities; the confidence is the probability. A document's main language
has the most letters over its lines. Equal lines, digits apart, are classified once per worker.

Defined results: a null, empty or blank text, and one with nothing but code, has no language and no row; a line
of fewer than ``LETTERS`` letters, or given another language with less than ``LEAST_CONFIDENCE``, counts for the
document's language and isn't listed by itself; ties
go to the first of ``LANGUAGES``; without sentences of known language nothing can be told and no row is given.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "ko", "ja", "zh", "de", "fr", "es", "pt")
#: ISO codes of two and three letters and English names of the languages; fixed values.
NAMES = {
    "en": "en", "eng": "en", "english": "en", "ko": "ko", "kor": "ko", "korean": "ko",
    "ja": "ja", "jpn": "ja", "japanese": "ja", "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh", "cmn": "zh",
    "de": "de", "deu": "de", "ger": "de", "german": "de", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "es": "es", "spa": "es", "spanish": "es", "pt": "pt", "por": "pt", "portuguese": "pt",
}
WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4), 24
LETTERS, LEAST_CONFIDENCE = 20, 0.5
DOCUMENTS, LINES, LINES_OF_ONE, EPOCHS, LEAST_EXAMPLES, SEED = 4_000, 1_500, 100, 3, 60_000, 11
REMEMBERED = 300_000

_LETTER = re.compile(r"[^\W\d_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&[a-z]{2,6};|https?://\S+")
_LEAD = re.compile(r"^\s*(?:(?:[#>*=+•\-]+|\(?\[?\d+[\]).:]*|\|)\s+)*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_WIDE = re.compile("[ᄀ-ᇿ぀-ヿ㄰-㆏㐀-鿿가-힯豈-﫿]")
_CODE_SIGNS = (*'{}[]=<>|$\\_"@;', "::")  # "->" is counted by its ">"
_CALL = re.compile(r"[^\W_]\(")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:[-'’·][^\W\d_]+)*")
_EDGES = "\"'“”‘’«»„‚‹›()[]{},.:;!?¿¡…*_`|"


def label_of(text: str | None) -> str | None:
    """The language that a label names in any of its forms, if it names one."""
    return NAMES.get(re.split(r"[-_]", text.strip().lower())[0]) if text else None


def tidy(line: str) -> str:
    """A line as it is classified: compatible forms, no invisible signs, lower case, any number as 0."""
    line = line.strip()
    if not line.isascii():
        line = unicodedata.normalize("NFKC", _INVISIBLE.sub("", line))
    return re.sub(r"\d+", "0", line.lower())


_NO_ASCII_LETTERS = bytes(k for k in range(128) if not chr(k).isalpha())


def letters_of(line: str) -> int:
    if line.isascii():
        return len(line.encode().translate(None, _NO_ASCII_LETTERS))
    return sum(map(len, _LETTER.findall(line)))


def is_prose(line: str) -> bool:
    """Whether a line is language, by its form."""
    bare = _MARKUP.sub(" ", line) if "<" in line or "&" in line or "http" in line else line
    bare = _LEAD.sub("", bare).strip()
    letters = letters_of(bare)
    if not letters or letters < 2:
        return False
    wide = 0 if bare.isascii() else len(_WIDE.findall(bare))
    if wide * 2 >= letters:
        return len(set(bare)) > 3
    plain = [w for w in (w if w.isalpha() else w.strip(_EDGES) for w in bare.split()) if w.isalpha() or _PLAIN_WORD.fullmatch(w)]
    inside = letters_of("".join(plain))
    if inside + wide < 0.7 * letters or len(plain) < 3 or letters >= LETTERS and len(set(plain)) < 3:
        return False
    if bare.count("0") > len(plain) and len(_NUMBER.findall(bare)) > len(plain):  # sums and dates; any digits are 0 here
        return False
    signs = sum(map(bare.count, _CODE_SIGNS)) + (len(_CALL.findall(bare)) if "(" in bare else 0)
    return signs < max(2, 0.35 * len(plain))


class Network:
    """Multi-width byte filters, max pooling and softmax; parameters as tables of one row per byte value."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.tables = {w: rng.normal(0, 0.15, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(LANGUAGES))).astype(np.float32)
        self.out_bias = np.zeros(len(LANGUAGES), np.float32)

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        t = self.tables[w]
        r = t[0][x[:, :n]]
        for k in range(1, w):
            r += t[k][x[:, k : k + n]]
        return r

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window's languages. Rows of two neighbouring bytes are added beforehand: one look-up for two bytes."""
        pairs = {(w, k): (self.tables[w][k][:, None] + self.tables[w][k + 1][None]).reshape(65_536, FILTERS) for w in WIDTHS for k in range(0, w - 1, 2)}
        parts = []
        for k in range(0, len(x), 128):
            b = np.ascontiguousarray(x[k : k + 128].T)  # places first: the maximum over them runs along whole rows
            two = (b[:-1].astype(np.int32) << 8) + b[1:]
            pooled = []
            for w in WIDTHS:
                n = len(b) - w + 1
                r = pairs[w, 0].take(two[:n], axis=0)
                for j in range(2, w - 1, 2):
                    r += pairs[w, j].take(two[j : j + n], axis=0)
                if w % 2:
                    r += self.tables[w][w - 1].take(b[w - 1 : w - 1 + n], axis=0)
                pooled.append(np.maximum(0, r.max(axis=0) + self.bias[w]))
            z = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(parts) if parts else np.zeros((0, len(LANGUAGES)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = SEED, rate: float = 0.05) -> Network:
        """AdaGrad on the cross entropy; only the byte rows under a pooled maximum have a gradient."""
        rng = np.random.default_rng(seed)
        squares = {w: np.full_like(self.tables[w], 0.1) for w in WIDTHS}
        squares_bias = {w: np.full(FILTERS, 0.1, np.float32) for w in WIDTHS}
        squares_out, squares_out_bias = np.full_like(self.out, 0.1), np.full_like(self.out_bias, 0.1)
        column = np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(order), 64):
                b, t = x[order[k : k + 64]], y[order[k : k + 64]]
                at, pooled = {}, []
                for w in WIDTHS:
                    r = self.responses(b, w)
                    at[w] = r.argmax(axis=1)
                    pooled.append(np.maximum(0, np.take_along_axis(r, at[w][:, None, :], 1)[:, 0] + self.bias[w]))
                h = np.concatenate(pooled, 1)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(t)), t] -= 1
                p /= len(t)
                down = (p @ self.out.T) * (h > 0)
                g = h.T @ p + 1e-4 * self.out
                squares_out += g * g
                self.out -= rate * g / np.sqrt(squares_out)
                g = p.sum(axis=0)
                squares_out_bias += g * g
                self.out_bias -= rate * g / np.sqrt(squares_out_bias)
                for i, w in enumerate(WIDTHS):
                    d = down[:, i * FILTERS : (i + 1) * FILTERS]
                    g = d.sum(axis=0)
                    squares_bias[w] += g * g
                    self.bias[w] -= rate * g / np.sqrt(squares_bias[w])
                    for j in range(w):
                        g = np.zeros((256, FILTERS), np.float32)
                        np.add.at(g, (np.take_along_axis(b, at[w] + j, 1), column[None, :]), d)
                        squares[w][j] += g * g
                        self.tables[w][j] -= rate * g / np.sqrt(squares[w][j])
        return self


def windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, line of each): the whole of every line; a last window reaches back, a short line is padded with blanks."""
    raw = [s.encode("utf-8", "replace") for s in lines]
    parts, owner = [], []
    for i, b in enumerate(raw):
        starts = [*range(0, max(1, len(b) - WINDOW + 1), WINDOW)]
        if len(b) > WINDOW and len(b) % WINDOW:
            starts.append(len(b) - WINDOW)
        parts += [b[s : s + WINDOW].ljust(WINDOW) for s in starts]
        owner += [i] * len(starts)
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)


def classified(network: Network, lines: list[str]) -> list[tuple[str, float]]:
    """(language, confidence) of each line."""
    if not lines:
        return []
    x, owner = windows(lines)
    total = np.zeros((len(lines), len(LANGUAGES)))
    np.add.at(total, owner, network.log_probabilities(x))
    total /= np.bincount(owner, minlength=len(lines))[:, None]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [(LANGUAGES[k], float(p[i, k])) for i, k in enumerate(best)]


def _order(line: str) -> tuple[int, str]:
    return zlib.crc32(line.encode("utf-8", "replace")), line


def trained(documents: DataFrame, samples: DataFrame) -> Network | None:
    """The network (none without a sentence of known language), from the sentences of known language and a bounded number of documents."""
    known = [(r[0], label_of(r[1])) for r in samples.select("text", "lang").orderBy(F.xxhash64("text"), "text", "lang").limit(LINES * len(LANGUAGES)).collect()]
    lines = [(tidy(t), LANGUAGES.index(c)) for t, c in sorted((t, c) for t, c in known if t and c)]
    if not lines:
        return None
    first = Network().fit(*_examples(lines), epochs=40)
    ids = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS)
    some = documents.select("doc_id", "lang", "text").join(ids, "doc_id", "left_semi").orderBy("doc_id")
    asked: dict[str, list[tuple[str, int]]] = {}
    taken = 0
    for _, lang, text in some.toLocalIterator():
        if code := label_of(lang):
            own = {_LEAD.sub("", tidy(line)) for line in text.split("\n") if letters_of(line) >= LETTERS and is_prose(tidy(line))}
            for line in sorted(own, key=_order)[:LINES_OF_ONE]:
                asked.setdefault(line, []).append((code, taken))
            taken += 1
    answers = dict(zip(asked, classified(first, list(asked)), strict=True))
    votes: dict[int, list[int]] = {}
    for line, owners in asked.items():
        for code, doc in owners:
            vote = votes.setdefault(doc, [0, 0])
            vote[answers[line][0] == code] += letters_of(line)
    # a label counts where most of its document speaks for it, for the lines that aren't clearly in another language
    labelled: dict[str, set[str]] = {}
    for line, owners in asked.items():
        for code, doc in owners:
            if votes[doc][1] > votes[doc][0] and (answers[line][0] == code or answers[line][1] < 0.8):
                labelled.setdefault(line, set()).add(code)
    more = []
    for c in LANGUAGES:
        own = sorted(t for t, codes in labelled.items() if codes == {c})
        pick = np.random.default_rng(SEED).permutation(len(own))[:LINES]
        more += [(own[i], LANGUAGES.index(c)) for i in pick]
    # the same without accents, as some texts are written
    bare = ((unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), c) for t, c in lines + more if LANGUAGES[c] in ("de", "fr", "es", "pt"))
    both = lines * 3 + more + [(t, c) for t, c in bare if letters_of(t) >= LETTERS]
    # every language weighs the same
    by = [[e for e in both if e[1] == k] for k in range(len(LANGUAGES))]
    most = max(map(len, by))
    both = [e for own in by if own for e in (own * (most // len(own) + 1))[:most]]
    x, y = _examples(both)
    return Network().fit(x, y, epochs=max(EPOCHS, LEAST_EXAMPLES // len(x)))


def _examples(lines: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    x, owner = windows([t for t, _ in lines])
    # the beginnings of lines also as short lines, so that windows of mostly blanks are known
    s, short = windows([t[:LETTERS] for t, _ in lines])
    y = np.array([k for _, k in lines])
    return np.concatenate([x, s]), np.concatenate([y[owner], y[short]])


@lru_cache(4)
def _held(payload: bytes) -> tuple[Network, dict]:
    import pickle

    return pickle.loads(payload), {}


def language_rows(network: Network, memory: dict, texts: list[str | None], labels: list[str | None]) -> list[tuple[int, int, str, float, bool]]:
    """(number of text, line number, language, confidence, whether it is a case) for the texts (line 0) and their lines.

    ``memory``: line -> (language, confidence, letters), without a language for what is no prose.
    """
    parts: list[list[tuple[int, str, int]]] = []
    asked: dict[str, int] = {}
    for t in texts:
        own = []
        for n, line in enumerate((t or "").split("\n"), 1):
            if not line or line.isspace():
                continue
            key = tidy(line)
            if key not in memory:
                if is_prose(key):
                    asked[key] = letters_of(key)
                memory[key] = (None, 0.0, asked.get(key, 0))
            known = memory[key]
            if known[0] is None and key not in asked:
                continue
            own.append((n, key, known[2]))
        parts.append(own)
    for key, answer in zip(asked, classified(network, [_LEAD.sub("", k) for k in asked]), strict=True):
        memory[key] = (*answer, asked[key])
    out = []
    for i, (own, label) in enumerate(zip(parts, labels, strict=True)):
        weight = dict.fromkeys(LANGUAGES, 0)
        sure = dict.fromkeys(LANGUAGES, 0.0)
        for _, key, letters in own:
            lang, p, _ = memory[key]
            weight[lang] += letters
            sure[lang] += letters * p
        if not any(weight.values()):
            continue
        main = max(LANGUAGES, key=weight.get)
        out.append((i, 0, main, sure[main] / weight[main], label_of(label) != main))
        for n, key, letters in own:
            lang, p, _ = memory[key]
            if lang != main and letters >= LETTERS and p >= LEAST_CONFIDENCE:
                out.append((i, n, lang, p, True))
    if len(memory) > REMEMBERED:
        memory.clear()
    return out


def languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang, confidence, is_case): a row of each document with a language, and of each line in another one."""
    import pickle

    schema = "doc_id bigint, line_no int, lang string, confidence double, is_case boolean"
    if (network := trained(documents, samples)) is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(network))  # about 0.3 MB, of fixed size

    def run(batches):
        network, memory = _held(shared.value)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = language_rows(network, memory, b.column(1).to_pylist(), b.column(2).to_pylist())
            cols = [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "line_no", "lang", "confidence", "is_case"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(run, schema)


def found(documents: DataFrame, samples: DataFrame) -> DataFrame:
    return languages(documents, samples).where("is_case").select("doc_id", "line_no", "lang").distinct()
