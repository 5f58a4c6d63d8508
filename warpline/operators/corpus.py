"""Corpus statistics: tokens, vocabularies by first occurrence, windows, co-occurrence, PPMI, unigram distributions.

A token's position is (document, place); windows never cross documents. Places are kept as data, so no step
relies on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warpline.functions.numeric import divided, r6
from warpline.session import if_small, settled

_BLANKS = "[ \t\r\n]+"
#: Bytes of a vocabulary (words, ids and offsets) that are sent to the executors at most; about 1,500,000 words.
BYTES_SENT = 1 << 25
#: Tokens whose vectors are laid out at once.
TOKENS_AT_ONCE = 32_768


def split_collapsed(text: Column) -> Column:
    """Words between any blanks."""
    return F.filter(F.split(F.lower(text), _BLANKS), lambda w: w != "")


def split_preprocessed(text: Column) -> Column:
    """Lower case, a blank before every full stop, split on each single blank; empty words stay."""
    return F.split(F.replace(F.lower(text), F.lit("."), F.lit(" .")), " ")


def tokens(documents: DataFrame, text: str = "text", words=split_collapsed) -> DataFrame:
    """(doc_id, pos, word)"""
    return documents.select("doc_id", F.posexplode(words(F.col(text))).alias("pos", "word"))


def vocabulary(toks: DataFrame) -> DataFrame:
    """(word, word_id, n): ids from 0 by first occurrence in (doc_id, pos).

    The only total order is over the distinct words.
    """
    first = toks.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("n"))
    return first.select("word", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("word_id"), "n")


def encoded(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, word_id); words outside the vocabulary are in ``unknown_words``."""
    return toks.join(vocab.select("word", "word_id"), "word").select("doc_id", "pos", "word_id")


def unknown_words(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    return toks.join(vocab, "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))


def decoded(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, text) from the ids in order."""
    rows = ids.join(vocab.select("word", "word_id"), "word_id")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda r: r["word"]), " ").alias("text"))


def told_apart(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The documents whose id stands in one row, and the rows of the others (None: there are none)."""
    again = settled(documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    if again.isEmpty():
        return documents, None
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    return documents.join(again, same, "left_anti"), documents.join(again, same, "left_semi")


def _sent(vocab: DataFrame):
    """The words and their ids in the order of ids, as a broadcast value; None if they are more than ``BYTES_SENT``."""
    size = vocab.agg(F.coalesce(F.sum(F.octet_length("word") + 12), F.lit(0))).first()[0]
    if size > BYTES_SENT:
        return None
    t = vocab.select("word", "word_id").toArrow()
    t = t.take(pa.array(np.argsort(t.column("word_id").to_numpy()))).combine_chunks()
    return vocab.sparkSession.sparkContext.broadcast((pa.concat_arrays([pa.array([], pa.string()), *t.column("word").chunks]), t.column("word_id").to_numpy()))


def _flat(b: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The elements of a column of lists without nulls, and the number of each element's row."""
    lists = b.column(column)
    return lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _places(flat: pa.Array, words: pa.Array) -> np.ndarray:
    """The place of each word among the given words, -1 if it isn't there."""
    d = flat.dictionary_encode()
    at = pc.fill_null(pc.index_in(d.dictionary, value_set=words), -1).to_numpy(zero_copy_only=False)
    return at[d.indices.to_numpy()].astype(np.int64)


def _lists(b: pa.RecordBatch, column: str, values: pa.Array, row: np.ndarray) -> pa.RecordBatch:
    """(doc_id, column) with the values of each row as a list; rows without values are left out."""
    n = np.bincount(row, minlength=b.num_rows)
    some = np.flatnonzero(n)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[some])].astype(np.int32)), values)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(some)), lists], names=["doc_id", column])


def word_lists(documents: DataFrame, words=split_collapsed) -> DataFrame:
    """(doc_id, words) of the documents that have words."""
    return documents.select("doc_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)


def encoded_lists(lists: DataFrame, sent) -> DataFrame:
    """(doc_id, ids): ``encoded`` of whole documents with a vocabulary that is sent along; no token is shuffled."""

    def run(batches):
        words, ids = sent.value
        for b in batches:
            flat, row = _flat(b, "words")
            at = _places(flat, words)
            known = at >= 0
            yield _lists(b, "ids", pa.array(ids[at[known]]), row[known])

    return lists.mapInArrow(run, T.StructType([lists.schema["doc_id"], T.StructField("ids", T.ArrayType(T.LongType()))]))


def decoded_lists(encoded_: DataFrame, sent) -> DataFrame:
    """(doc_id, text): ``decoded`` of the lists of ids, again without a shuffle."""

    def run(batches):
        words, ids = sent.value
        for b in batches:
            flat, row = _flat(b, "ids")
            own = flat.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            known = ids[at] == own if len(ids) else np.zeros(len(own), bool)
            out = _lists(b, "words", words.take(pa.array(at[known])), row[known])
            yield pa.RecordBatch.from_arrays([out.column("doc_id"), pc.binary_join(out.column("words"), " ")], names=["doc_id", "text"])

    return encoded_.mapInArrow(run, T.StructType([encoded_.schema["doc_id"], T.StructField("text", T.StringType())]))


def recoded(documents: DataFrame) -> DataFrame:
    """(doc_id, text): all documents encoded with their own vocabulary and decoded again.

    A vocabulary of at most ``BYTES_SENT`` is sent along; with a larger one, and for ids that stand in several rows,
    tokens are joined with it. Both give the same rows.
    """
    vocab = settled(vocabulary(tokens(documents)))
    joined = lambda d: decoded(encoded(tokens(d), vocab), vocab)
    sent = _sent(vocab)
    if sent is None:
        return joined(documents)
    once, again = told_apart(documents)
    out = decoded_lists(encoded_lists(word_lists(once), sent), sent)
    return out if again is None else out.unionByName(joined(again))


def _summed(vectors: pa.Table, words: pa.Array) -> list[np.ndarray]:
    """Of (word, vec), by word and component: the sum of the numbers, how many there are, and the rows, nulls included.

    Rows of a word add up; shorter vectors have no rows in the components that they lack.
    """
    vec = pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *vectors.column("vec").chunks])
    n = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(n)), n), vec.flatten()
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = pc.index_in(vectors.column("word").combine_chunks(), value_set=words).to_numpy(zero_copy_only=False)[row]
    there = flat.is_valid().to_numpy(zero_copy_only=False)
    out = [np.zeros((len(words), int(n.max(initial=0)))) for _ in range(3)]
    for table, value in zip(out, (pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), there, 1.0)):
        np.add.at(table, (at, j), value)
    total, many, rows = out
    # the usual case, whole vectors: one column of counts serves for all components
    return [total, many[:, :1], rows[:, :1]] if (many == rows[:, :1]).all() and (rows == rows[:, :1]).all() else out


def context_weights(place: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """In how many contexts of ``contexts`` the word at each place of a document of so many words stands."""
    targets = [place - k for k in range(-window, window + 1) if k]
    return sum(((t >= window) & (t < length - window)).astype(np.int64) for t in targets)


def _means_joined(documents: DataFrame, words: DataFrame, window: int) -> DataFrame:
    near = contexts(documents, window=window).select("doc_id", F.explode("context").alias("word"))
    # counted per document and word first, so that frequent words don't multiply the join
    counted = near.groupBy("doc_id", "word").agg(F.count("*").alias("k"))
    j = counted.join(words.select("word", F.posexplode("vec").alias("j", "x")), "word")
    return j.groupBy("doc_id", "j").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("x")).alias("s"), F.sum(F.when(F.col("x").isNotNull(), F.col("k"))).alias("m"))


def context_means(documents: DataFrame, vectors: DataFrame, window: int = 2) -> DataFrame:
    """(doc_id, j, n, v): the mean of the vectors of all context words of a document that have one, component by component.

    ``vectors``: (word_id, vec), by the vocabulary of the documents. n counts null components, v is the mean of the others.
    The words that have a vector, of which there are no more than vectors, are sent along if they and their numbers are
    at most ``BYTES_SENT``, so that neither tokens nor sums are shuffled; else, and for ids that stand in several
    rows, counts of words are joined with them. Both give the same rows.
    """
    words = settled(vocabulary(tokens(documents)).select("word", "word_id").join(vectors, "word_id").select("word", "vec"))
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + 4), F.lit(0)), F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    mean = lambda d: d.select("doc_id", "j", "n", r6(F.col("s") / F.nullif("m", F.lit(0)), 4).alias("v"))
    if size[0] + 24 * size[1] * size[2] > BYTES_SENT:
        return mean(_means_joined(documents, words, window))
    table = words.toArrow()
    known = table.column("word").unique()
    sent = documents.sparkSession.sparkContext.broadcast((known, _summed(table, known)))
    once, again = told_apart(documents)
    lists = word_lists(once)
    kind = T.StructType([lists.schema["doc_id"], T.StructField("j", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("m", T.LongType())])

    def run(batches):
        words, tables = sent.value
        for b in batches:
            flat, row = _flat(b, "words")
            length = np.bincount(row, minlength=b.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            weight = context_weights(place, length[row], window)
            at = _places(flat, words)
            use = (weight > 0) & (at >= 0)
            at, row, weight = at[use], row[use], weight[use]
            s, m, n = (np.zeros((b.num_rows, t.shape[1])) for t in tables)
            for start in range(0, len(at), TOKENS_AT_ONCE):
                cut = slice(start, start + TOKENS_AT_ONCE)
                first = np.flatnonzero(np.r_[True, row[cut][1:] != row[cut][:-1]])
                for out, t in zip((s, m, n), tables):
                    out[row[cut][first]] += np.add.reduceat(t[at[cut]] * weight[cut, None], first)
            m, n = (np.broadcast_to(x, s.shape) for x in (m, n))
            doc, j = np.nonzero(n)
            pick = lambda x, t: pa.array(x[doc, j].astype(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(j.astype(np.int32)), pick(n, np.int64), pick(s, float), pick(m, np.int64)], names=kind.names)

    out = mean(lists.mapInArrow(run, kind))
    return out if again is None else out.unionByName(mean(_means_joined(again, words, window)))


def word_counts(toks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word_id, n) of every word of the vocabulary, 0 of those that don't occur."""
    return vocab.select("word", "word_id").join(toks.groupBy("word").agg(F.count("*").alias("n")), "word", "left").select("word_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def unigram(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """(word_id, p, low, cdf): the powered distribution and the interval of each word in its cumulative form, whose last end is 1.

    The total order is over the vocabulary, not over the tokens.
    """
    p = counts.withColumn("w", F.when(F.col("n") > 0, F.pow("n", F.lit(power))).otherwise(0.0))
    w = Window.orderBy("word_id")
    p = p.crossJoin(p.agg(F.sum("w").alias("total"), F.max("word_id").alias("last")))
    p = p.withColumn("cdf", F.when(F.col("word_id") == F.col("last"), 1.0).otherwise(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")))
    return p.select("word_id", (F.col("w") / F.col("total")).alias("p"), F.coalesce(F.lag("cdf").over(w), F.lit(0.0)).alias("low"), "cdf")


def contexts(documents: DataFrame, words=split_collapsed, window: int = 2) -> DataFrame:
    """(doc_id, pos, context, target) of the places with a full window.

    The windows are made inside the array of words, so what is exploded is linear in the text.
    """
    w = F.col("words")
    full = documents.select("doc_id", words(F.col("text")).alias("words")).where(F.size("words") > 2 * window)
    places = F.sequence(F.lit(window), F.size("words") - window - 1)
    cell = lambda i: F.struct(i.alias("pos"), F.array(*[F.get(w, i + k) for k in range(-window, window + 1) if k]).alias("context"), F.get(w, i).alias("target"))
    return full.select("doc_id", F.inline(F.transform(places, cell)))


def _ahead(words: Column, places: Column, k: int) -> Column:
    return F.transform(places, lambda i: F.struct(F.get(words, i).alias("word"), F.get(words, i + k).alias("other")))


def pairs(documents: DataFrame, words=split_collapsed, window: int = 1) -> DataFrame:
    """(word, other) of all places at most ``window`` apart, in both directions, edges included."""
    w = F.col("words")
    rows = documents.select(words(F.col("text")).alias("words")).where(F.size("words") > 1)
    places = F.sequence(F.lit(0), F.size("words") - 1)
    ahead = [_ahead(w, places, k) for k in range(1, window + 1)]
    one = rows.select(F.inline(F.concat(*ahead))).where("other is not null")
    return one.unionByName(one.select(F.col("other").alias("word"), F.col("word").alias("other")))


def cooccurrence(documents: DataFrame, words=split_collapsed, window: int = 1) -> DataFrame:
    """(word, other, n): sparse and symmetric."""
    w = F.col("words")
    rows = documents.select(words(F.col("text")).alias("words")).where(F.size("words") > 1)
    places = F.sequence(F.lit(0), F.size("words") - 1)
    ahead = [_ahead(w, places, k) for k in range(1, window + 1)]
    # counted in one direction first; the mirrored pairs are added to the counts, not to the rows
    once = rows.select(F.inline(F.concat(*ahead))).where("other is not null").groupBy("word", "other").agg(F.count("*").alias("n"))
    swapped = once.select(F.col("other").alias("word"), F.col("word").alias("other"), "n")
    return once.unionByName(swapped).groupBy("word", "other").agg(F.sum("n").alias("n"))


def ppmi(counts: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(word, other, ppmi): max(0, log2(n * N / (s_word * s_other) + eps)); column sums serve for both axes.

    The counts are read three times and so written down; the sums, one row a word, are sent along while they are few.
    """
    counts = settled(counts)
    sums = settled(counts.groupBy("other").agg(F.sum("n").cast("double").alias("s")))
    total = sums.agg(F.sum("s").alias("all"))
    sums = if_small(sums)
    rows = counts.join(sums.select(F.col("other"), F.col("s").alias("so")), "other").join(sums.select(F.col("other").alias("word"), F.col("s").alias("sw")), "word").crossJoin(total)
    value = F.greatest(F.lit(0.0), F.log2(divided(F.col("n") * F.col("all"), F.col("sw") * F.col("so")) + eps))
    return rows.select("word", "other", r6(value, 5).alias("ppmi"))


def character_vocabulary(documents: DataFrame) -> DataFrame:
    """(ch, ch_id): ids of characters by first occurrence in (doc_id, pos)."""
    chars = documents.select("doc_id", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    first = chars.groupBy("ch").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    return first.select("ch", (F.row_number().over(Window.orderBy("at")) - 1).cast("bigint").alias("ch_id"))


def digests(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.sha2("text", 256).alias("digest"))


def batch_positions(total: int, batch: int, span: int, step: int) -> list[list[int]]:
    """Places of the tokens that step ``step`` of truncated training reads: one row per parallel stream."""
    jump = total // batch
    return [[(b * jump + step * span + t) % total for t in range(span)] for b in range(batch)]


def streams(ids: DataFrame, batch: int, span: int) -> DataFrame:
    """(step, stream, t, word_id): the whole corpus as ``batch`` parallel streams, cut into spans.

    ``ids`` has a global place ``at``; the grid isn't made, each place is told its step and stream.
    """
    n = ids.agg(F.count("*").alias("n"))
    jump = F.expr(f"n div {batch}")
    rows = ids.crossJoin(n).withColumn("jump", jump).where(F.col("jump") > 0)
    rows = rows.where(F.col("at") < F.col("jump") * batch)
    inside = F.pmod("at", "jump")
    return rows.select(F.floor(inside / span).alias("step"), F.expr("at div jump").alias("stream"), F.pmod(inside, F.lit(span)).alias("t"), "word_id")


def global_places(toks: DataFrame) -> DataFrame:
    """Tokens with their place ``at`` in the whole corpus, without ordering it in one task: documents' lengths are summed up, not tokens."""
    lengths = toks.groupBy("doc_id").agg(F.count("*").alias("len"))
    before = Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select("doc_id", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("start"))
    return toks.join(starts, "doc_id").withColumn("at", F.col("start") + F.col("pos")).drop("start")


def exact_and_token_accuracy(pairs_: DataFrame, target: str, guess: str) -> DataFrame:
    """(exact_match, token_accuracy) of sequences of tokens."""
    same = F.aggregate(F.zip_with(target, guess, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return pairs_.agg(r6(F.avg((F.col(target) == F.col(guess)).cast("int"))).alias("exact_match"), r6(F.sum(same) / F.sum(F.size(target))).alias("token_accuracy"))
