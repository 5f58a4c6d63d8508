"""Queries on corpora take whole inputs without shuffling their tokens."""

from conftest import rows

from warpline.operators import corpus
from warpline.plans import more, texts_and_vectors


def exchanges(df):
    """The shuffles in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ")


def test_decoding_shuffles_no_tokens(spark, monkeypatch):
    d = spark.createDataFrame([(1, "B  a\tb"), (2, None), (3, " \n"), (4, "c a"), (None, "a")], "doc_id bigint, text string")
    want = {(1, "b a b"), (4, "c a"), (None, "a")}
    got = texts_and_vectors.corpus_decode(d)
    assert rows(got) == want and got.count() == 3 and exchanges(got) == 0
    again = d.unionByName(spark.createDataFrame([(4, None), (5, "x"), (5, "x")], "doc_id bigint, text string"))
    assert rows(texts_and_vectors.corpus_decode(again)) == want | {(5, "x x")}
    assert rows(texts_and_vectors.corpus_decode(d.where("doc_id < 0"))) == set()
    monkeypatch.setattr(corpus, "BYTES_SENT", 20)
    joined = texts_and_vectors.corpus_decode(again)
    assert rows(joined) == want | {(5, "x x")} and exchanges(joined) > 0


def test_lists_leave_out_words_and_ids_that_are_unknown(spark):
    sent = corpus._sent(spark.createDataFrame([("b", 7), ("a", 3)], "word string, word_id bigint"))
    lists = spark.createDataFrame([(1, ["a", "x", "b", "a"]), (2, ["x"])], "doc_id bigint, words array<string>")
    assert [tuple(r) for r in corpus.encoded_lists(lists, sent).collect()] == [(1, [3, 7, 3])]
    ids = spark.createDataFrame([(1, [7, 5, 3, 9]), (2, [0])], "doc_id bigint, ids array<bigint>")
    assert rows(corpus.decoded_lists(ids, sent)) == {(1, "b a")}


def test_means_of_contexts_shuffle_neither_tokens_nor_sums(spark, monkeypatch):
    texts = [(1, "a b c d e"), (2, "a a b b c c d"), (3, "a b c d"), (4, None), (5, "e e e e e e"), (8, "b b b b b"), (6, "x y z x y z"), (7, "a b c d e"), (7, "e d c b a")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, None]), (3, [0.5]), (3, [2.5, 7.0]), (4, None), (9, [9.0, 9.0])], "vec_id bigint, embedding array<float>")
    vectors = {"a": [[1.0, 2.0]], "b": [[4.0, None]], "d": [[0.5], [2.5, 7.0]]}  # the words of ids 0, 1 and 3
    counts = {}
    for doc, text in texts:
        w = (text or "").split()
        for t in range(2, len(w) - 2):
            for word in (w[t - 2], w[t - 1], w[t + 1], w[t + 2]):
                for vec in vectors.get(word, []):
                    for j, x in enumerate(vec):
                        counts.setdefault((doc, j), []).append(x)
    some = lambda xs: [x for x in xs if x is not None]
    want = {(doc, j, len(xs), round(sum(some(xs)) / len(some(xs)), 4) if some(xs) else None) for (doc, j), xs in counts.items()}
    assert {w[0] for w in want} == {1, 2, 7, 8} and (8, 1, 4, None) in want
    assert rows(more.corpus_cbow_encode(d, e)) == want
    monkeypatch.setattr(corpus, "TOKENS_AT_ONCE", 3)
    one = more.corpus_cbow_encode(d.where("doc_id <> 7"), e)
    assert rows(one) == {w for w in want if w[0] != 7} and exchanges(one) == 0
    assert rows(more.corpus_cbow_encode(d, e.where("vec_id > 4"))) == rows(more.corpus_cbow_encode(d.where("doc_id > 9"), e)) == set()
    even = e.where("vec_id in (0, 9)")
    whole = rows(more.corpus_cbow_encode(d, even))
    assert (2, 1, 3, 2.0) in whole and {w[0] for w in whole} == {1, 2, 7}
    monkeypatch.setattr(corpus, "BYTES_SENT", 20)
    assert rows(more.corpus_cbow_encode(d, e)) == want and rows(more.corpus_cbow_encode(d, even)) == whole
