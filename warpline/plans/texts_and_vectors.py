"""Queries on corpora and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.operators import corpus as C
from warpline.operators import vectors as V
from warpline.plans.registry import Registry

registry = Registry()
add = registry.add

TOKENS = """
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\r\\n]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
tokens AS (SELECT doc_id, unnest(range(len(words)))::INT AS pos, unnest(words) AS word FROM docs),
vocab AS (
  SELECT word, row_number() OVER (ORDER BY first_at) - 1 AS word_id, n FROM (
    SELECT word, min({'d': doc_id, 'p': pos}) AS first_at, count(*) AS n FROM tokens GROUP BY word))
"""
VECTORS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, CASE WHEN list_dot_product(e, e) = 0 THEN e ELSE list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) END AS n FROM v)
"""

add("corpus_tokens", "documents", sql=TOKENS + "SELECT doc_id, pos, word FROM tokens")(C.tokens)
add("corpus_preprocess", "documents", sql="SELECT doc_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS word FROM (SELECT doc_id, string_split(replace(lower(text), '.', ' .'), ' ') AS w FROM documents WHERE text IS NOT NULL)")(lambda d: C.tokens(d, words=C.split_preprocessed))
add("corpus_vocabulary", "documents", sql=TOKENS + "SELECT word, word_id, n FROM vocab")(lambda d: C.vocabulary(C.tokens(d)))


@add("corpus_encode", "documents", sql=TOKENS + "SELECT doc_id, pos, word_id FROM tokens JOIN vocab USING (word)")
def corpus_encode(d):
    t = C.tokens(d)
    return C.encoded(t, C.vocabulary(t))


@add("corpus_decode", "documents", sql=TOKENS + "SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text FROM tokens GROUP BY doc_id")
def corpus_decode(d):
    return C.recoded(d)


_SPLIT = "lower(coalesce(source, '')) LIKE '%e0_'"


@add("corpus_unknown_words", "documents", sql=TOKENS + """, known AS (SELECT DISTINCT word FROM tokens WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_type = 'notes'))
SELECT word, count(*) AS n FROM tokens WHERE word NOT IN (SELECT word FROM known) GROUP BY word""")
def corpus_unknown_words(d):
    """Words of all documents that the notes, as the training split, don't have."""
    return C.unknown_words(C.tokens(d), C.vocabulary(C.tokens(d.where("doc_type = 'notes'"))))


@add("corpus_word_counts", "documents", sql=TOKENS + "SELECT v.word_id, count(t.word) AS n FROM vocab v LEFT JOIN tokens t USING (word) GROUP BY v.word_id")
def corpus_word_counts(d):
    """How often each word of the vocabulary stands in all documents."""
    return C.word_counts(C.tokens(d), C.vocabulary(C.tokens(d)))


@add("corpus_unigram", "documents", sql=TOKENS + ", w AS (SELECT word_id, pow(n, 0.75) AS w FROM vocab) SELECT word_id, round(w / sum(w) OVER (), 9) + 0.0 AS p, CASE WHEN word_id = max(word_id) OVER () THEN 1.0 ELSE round(sum(w) OVER (ORDER BY word_id) / sum(w) OVER (), 6) + 0.0 END AS cdf FROM w")
def corpus_unigram(d):
    v = C.vocabulary(C.tokens(d))
    return C.unigram(v.select("word_id", "n")).select("word_id", C.r6(F.col("p"), 9).alias("p"), C.r6(F.col("cdf")).alias("cdf"))


add("corpus_contexts", "documents", sql=TOKENS + """SELECT doc_id, pos, [words[pos - 1], words[pos], words[pos + 2], words[pos + 3]] AS context, words[pos + 1] AS target
FROM (SELECT doc_id, words, unnest(range(2, len(words) - 2))::INT AS pos FROM docs WHERE len(words) > 4)""")(C.contexts)
COUNTS = TOKENS + """, near AS (SELECT a.word, b.word AS other FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND (b.pos = a.pos + 1 OR b.pos = a.pos - 1)),
counts AS (SELECT word, other, count(*) AS n FROM near GROUP BY ALL)"""
add("corpus_cooccurrence", "documents", sql=COUNTS + "SELECT * FROM counts")(C.cooccurrence)
add("corpus_ppmi", "documents", sql=COUNTS + """, s AS (SELECT other AS w, sum(n)::DOUBLE AS s FROM counts GROUP BY 1)
SELECT c.word, c.other, round(greatest(0.0, log2(c.n * (SELECT sum(s) FROM s) / (a.s * b.s) + 1e-8)), 5) + 0.0 AS ppmi FROM counts c JOIN s a ON a.w = c.word JOIN s b ON b.w = c.other""")(lambda d: C.ppmi(C.cooccurrence(d)))
add("corpus_character_vocabulary", "documents", sql="SELECT ch, (row_number() OVER (ORDER BY first_at) - 1) AS ch_id FROM (SELECT ch, min({'d': doc_id, 'p': pos}) AS first_at FROM (SELECT doc_id, text[pos::BIGINT] AS ch, pos FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS pos FROM documents WHERE text IS NOT NULL)) GROUP BY 1)")(C.character_vocabulary)
add("corpus_digests", "documents", sql="SELECT doc_id, sha256(text) AS digest FROM documents")(C.digests)


@add("corpus_streams", "documents", sql=TOKENS + """, placed AS (SELECT word_id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM tokens JOIN vocab USING (word)),
j AS (SELECT count(*) AS total, count(*) // 20 AS jump FROM placed)
SELECT (place % jump) // 35 AS step, place // jump AS stream, (place % jump) % 35 AS t, word_id FROM placed, j WHERE place < jump * 20""")
def corpus_streams(d):
    """The corpus as 20 parallel streams in spans of 35 tokens."""
    t = C.global_places(C.tokens(d))
    return C.streams(t.join(C.vocabulary(C.tokens(d)).select("word", "word_id"), "word").select("at", "word_id"), 20, 35)


@add("sequence_pairs", "eval_items", sql="""WITH l AS (SELECT item_id, unnest(range(len(x)))::INT AS line, unnest(x) AS s FROM (SELECT item_id, string_split(text, chr(10)) AS x FROM eval_items WHERE item_set IN ('sum_test', 'calendar_test')))
SELECT item_id, line, trim(split_part(s, '_', 1)) AS question, substr(s, instr(s, '_')) AS answer FROM l WHERE instr(s, '_') > 0""")
def sequence_pairs(items):
    """(item_id, line, question, answer): lines split at their first underscore, which the answer keeps."""
    rows = items.where(F.col("item_set").isin("sum_test", "calendar_test")).select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    at = F.instr("s", "_")
    return rows.where(at > 0).select("item_id", "line", F.trim(F.substring_index("s", "_", 1)).alias("question"), F.expr("substr(s, instr(s, '_'))").alias("answer"))


@add("sequence_accuracy", "eval_items", sql="""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS s FROM eval_items WHERE item_set = 'sum_test'),
p AS (SELECT string_split(trim(split_part(s, '_', 2)), '') AS t, string_split(CAST(try_cast(regexp_extract(s, '^([0-9]+)\\+', 1) AS BIGINT) + try_cast(regexp_extract(s, '\\+([0-9]+)', 1) AS BIGINT) AS VARCHAR), '') AS g FROM l WHERE instr(s, '_') > 0)
SELECT round(avg((t = g)::INT), 6) + 0.0 AS exact_match, round(sum(len(list_filter(list_zip(t, g), lambda z: z[1] = z[2])))::DOUBLE / sum(len(t)), 6) + 0.0 AS token_accuracy FROM p""")
def sequence_accuracy(items):
    """Exact matches and characters right of the sums that the questions ask for."""
    s = items.where("item_set = 'sum_test'").select(F.explode(F.split("text", "\n")).alias("s")).where("instr(s, '_') > 0")
    part = lambda p: F.regexp_extract("s", p, 1).try_cast("bigint")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = s.select(chars(F.trim(F.split("s", "_")[1])).alias("t"), chars((part(r"^([0-9]+)\+") + part(r"\+([0-9]+)")).cast("string")).alias("g"))
    return C.exact_and_token_accuracy(rows, "t", "g")


add("sequence_reversed", "documents", sql=TOKENS + "SELECT doc_id, array_to_string(list_reverse(words), ' ') AS text FROM docs")(lambda d: d.where("text is not null").select("doc_id", F.array_join(F.reverse(C.split_collapsed(F.col("text"))), " ").alias("text")))

add("vectors_normalised", "embeddings", sql=VECTORS + "SELECT vec_id, list_transform(n, lambda x: round(x, 6) + 0.0) AS embedding FROM u")(lambda e: V.normalised(e).select("vec_id", F.transform("embedding", lambda x: F.round(x, 6) + F.lit(0.0)).alias("embedding")))
add("vectors_nearest", "embeddings", sql=VECTORS + """SELECT query_id, vec_id, round(s, 6) + 0.0 AS score, rank FROM (
  SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.n, u.n) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.n, u.n) DESC, u.vec_id)::INT AS rank
  FROM u q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")(V.nearest)
ANALOGY = VECTORS + """, raw AS (
  SELECT a.vec_id AS query_id, list_transform(list_zip(a.e, b.e, c.e), lambda z: z[2] - z[1] + z[3]) AS m
  FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 100 = 0),
q AS (SELECT query_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS m FROM raw),
s AS (SELECT query_id, vec_id, list_dot_product(m, e) AS s, CASE WHEN vec_id BETWEEN query_id AND query_id + 2 THEN '-inf'::DOUBLE ELSE list_dot_product(m, e) END AS masked FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY masked DESC, vec_id)::INT AS rank FROM s)
"""
add("vectors_analogies", "embeddings", sql=ANALOGY + "SELECT query_id, vec_id, round(s, 6) + 0.0 AS score, rank FROM r WHERE rank <= 5")(V.analogies)
add("vectors_expected_rank", "embeddings", sql=ANALOGY + "SELECT query_id, vec_id AS expected_id, rank::BIGINT AS expected_rank, rank <= 5 AS hit_at_5 FROM r WHERE vec_id = query_id + 3")(V.expected_ranks)
add("vectors_label_hits", "embeddings", sql=VECTORS + """, t AS (SELECT q.vec_id AS query_id, q.label AS wanted, u.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.n, u.n) DESC, u.vec_id) AS rank
  FROM u q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, count(*) FILTER (WHERE label = wanted) AS hits, count(*) FILTER (WHERE label = wanted) > 0 AS hit FROM t WHERE rank <= 5 GROUP BY query_id""")(V.label_hits)
add("vectors_centroid_cosine", "embeddings", sql=VECTORS + """, m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS x FROM v) GROUP BY ALL) GROUP BY label)
SELECT vec_id, label, round(list_dot_product(e, m) / sqrt(list_dot_product(e, e) * list_dot_product(m, m)), 6) + 0.0 AS cosine,
  round(list_dot_product(e, m) / ((sqrt(list_dot_product(e, e)) + 1e-8) * (sqrt(list_dot_product(m, m)) + 1e-8)), 6) + 0.0 AS textbook FROM u JOIN m USING (label)""")(V.centroid_scores)
