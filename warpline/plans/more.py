"""Queries on factors, recurrent layers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.functions.numeric import r6
from warpline.operators import corpus as C
from warpline.operators import factors, recurrent
from warpline.plans.registry import Registry
from warpline.plans.texts_and_vectors import TOKENS
from warpline.sources.tables import table
from warpline.streaming import events as E

registry = Registry()
add = registry.add


@add("vectors_singular_values", "embeddings")
def vectors_singular_values(e):
    values = factors.singular_values(e, "embedding")
    return e.sparkSession.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "place int, value double")


@add("corpus_ppmi_factors", "documents")
def corpus_ppmi_factors(d):
    """(word, vec): eight factors of the PPMI matrix of the corpus."""
    from warpline.session import settled

    matrix = settled(C.ppmi(C.cooccurrence(d)).where("ppmi > 0").select(F.col("word").alias("i"), F.col("other").alias("j"), F.col("ppmi").alias("v")))
    u, s = factors.randomized_svd(matrix, 8, 1)
    scale = F.array(*map(F.lit, s))
    return u.select(F.col("i").alias("word"), F.zip_with("vec", scale, lambda x, y: x * y).alias("vec"))


def _sequence():
    v = A.doubles("embedding")
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(v, t * 8 + 1, 8))


for _kind in recurrent.STEPS:
    add(f"layer_{_kind}", "embeddings")(lambda e, kind=_kind: recurrent.encoded(e.where("embedding is not null").select("vec_id", _sequence().alias("s")), F.col("s"), kind, 8, 6).select("vec_id", F.transform("state", lambda x: F.round(x, 6)).alias("state")))
add("layer_bidirectional_lstm", "embeddings")(lambda e: recurrent.encoded(e.where("embedding is not null").select("vec_id", _sequence().alias("s")), F.col("s"), "lstm", 8, 6, both_ways=True).select("vec_id", F.transform("state", lambda x: F.round(x, 6)).alias("state")))


@add("corpus_cbow_encode", "documents", "embeddings", sql=TOKENS + """, c AS (SELECT doc_id, pos, unnest([words[pos - 1], words[pos], words[pos + 2], words[pos + 3]]) AS word FROM (SELECT doc_id, words, unnest(range(2, len(words) - 2))::INT AS pos FROM docs WHERE len(words) > 4)),
e AS (SELECT vec_id AS word_id, unnest(range(len(embedding)))::INT AS j, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT doc_id, j, count(*) AS n, round(avg(x), 4) + 0.0 AS v FROM (SELECT doc_id, word_id FROM c JOIN vocab USING (word)) JOIN e USING (word_id) GROUP BY ALL""")
def corpus_cbow_encode(d, e):
    """(doc_id, j, n, v): the mean of the vectors of all context words of a document that have one, component by component."""
    return C.context_means(d, e.where("embedding is not null").select(F.col("vec_id").alias("word_id"), A.doubles("embedding").alias("vec")))


def _streamed(name: str, sql: str | None, path: str, build, mode: str):
    def query(spark, folder):
        schema = table(spark, folder, path).schema
        return E.finished(build(E.stream(spark, f"{folder}/{path}.parquet", schema)), mode, name)

    registry.queries[name] = query
    if sql:
        registry.sql[name] = sql


_streamed("stream_hourly", "SELECT (epoch_us(ts) // 3600000000) * 3600 AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL", "events", E.hourly, "complete")
_streamed("stream_closed_windows", """WITH w AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS win FROM events)
SELECT user_id, win AS "window", count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY ALL HAVING max((event_type = 'purchase')::INT) = 1""", "events", E.closed_windows, "append")
_streamed("stream_every_n", """WITH u AS (SELECT run_id, update_no, max(loss) AS loss, max(batch_size) AS units FROM updates WHERE loss IS NOT NULL AND isfinite(loss) GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY update_no) - 1 AS i FROM u)
SELECT run_id, ceil(i / 10)::BIGINT AS point, max(update_no) AS last_update, sum(units)::BIGINT AS unit_count, round(avg(loss), 6) + 0.0 AS mean FROM i GROUP BY 1, 2 HAVING max(i) = 10 * max(ceil(i / 10)::BIGINT)""", "updates", lambda u: E.every_n_points(u.select("run_id", "update_no", "loss", "batch_size")), "append")
_points = registry.queries["stream_every_n"]
registry.queries["stream_every_n"] = lambda spark, folder: _points(spark, folder).withColumn("mean", r6(F.col("mean")))
