"""Trainings and decoding on the held-out items, a table of fixed size, so that one task can hold what it trains on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators import corpus as C
from warpline.operators import seq2seq as S
from warpline.operators import trainers as T
from warpline.plans.registry import Registry

registry = Registry()
add = registry.add


def _sums(items: DataFrame) -> DataFrame:
    """(condition, question, answer) of the lines of sums and dates."""
    lines = items.where(F.col("item_set").isin("sum_test", "calendar_test")).select(F.col("item_set").alias("condition"), F.explode(F.split("text", "\n")).alias("s")).where("instr(s, '_') > 0")
    return lines.select("condition", F.trim(F.substring_index("s", "_", 1)).alias("question"), F.trim(F.expr("substr(s, instr(s, '_'))")).alias("answer"))


def _prose(items: DataFrame) -> DataFrame:
    return items.where("lang <> ''").select(F.col("item_id").alias("doc_id"), "text", F.col("item_set").alias("condition"))


@add("training_seq2seq", "eval_items")
def training_seq2seq(items):
    """(condition, seed, losses, exact_match): an encoder and a decoder without attention, questions read backwards."""
    return S.trained(_sums(items)).drop("predictions", "weights")


@add("training_seq2seq_attention", "eval_items")
def training_seq2seq_attention(items):
    return S.trained(_sums(items), attention=True, backwards=False).drop("predictions", "weights")


@add("decoding_greedy", "eval_items")
def decoding_greedy(items):
    """(condition, seed, question, answer, guess, token_correct): what the trained networks answer."""
    return S.trained(_sums(items)).select("condition", "seed", F.inline("predictions"))


@add("decoding_attention", "eval_items")
def decoding_attention(items):
    """(condition, seed, example, step, position, weight): where the decoder looks at each character that it writes."""
    rows = S.trained(_sums(items), attention=True).select("condition", "seed", F.posexplode("weights").alias("example", "w"))
    rows = rows.select("condition", "seed", "example", F.posexplode("w").alias("step", "w"))
    return rows.select("condition", "seed", "example", "step", F.posexplode("w").alias("position", "weight"))


for _kind in ("rnn", "lstm"):

    def _language_model(items, kind=_kind):
        """(condition, seed, epoch, perplexity, greedy, sampled) of a recurrent model of the next word, by truncated back-propagation."""
        words = C.tokens(_prose(items).drop("condition")).join(_prose(items).select("doc_id", "condition"), "doc_id")
        return T.trained_language_models(words.select("condition", "doc_id", "pos", "word"), seeds=2, epochs=4, dropout=0.2, decay=1e-4, kind=kind)

    add("training_language_model" + ("" if _kind == "rnn" else f"_{_kind}"), "eval_items")(_language_model)


for _kind in ("cbow", "skipgram"):

    def _word_vectors(items, kind=_kind):
        """(condition, seed, word, vector, losses): word vectors with negative sampling."""
        near = C.contexts(_prose(items).drop("condition")).join(_prose(items).select("doc_id", "condition"), "doc_id")
        return T.trained_word2vec(near.select("condition", "context", "target"), kind, seeds=2, epochs=4)

    add(f"training_word2vec_{_kind}", "eval_items")(_word_vectors)
