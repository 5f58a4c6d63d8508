"""Nearest vectors, analogies and ranks of expected answers, exact over all vectors.

The stated queries are worked through in blocks of ``BLOCK`` vectors that are sent to the executors, one pass over
all vectors each; these stream past, each batch is a matrix product with ``AT_ONCE`` queries at a time and keeps only
its best k a query, so what is shuffled is k rows a query and batch. The driver holds one block at a time.

Defined results: non-finite scores and excluded vectors rank as minus infinity, they aren't removed; ties go to
the smaller id; a zero vector scores 0; null vectors are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.functions.numeric import r6

BLOCK, AT_ONCE = 32_768, 512


def normalised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return vectors.select(key, A.unit(A.doubles(vector)).alias(vector))


def _blocks(queries: DataFrame):
    """The stated queries, a bounded block at a time."""
    block: list = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def best(vectors: DataFrame, queries: DataFrame, k: int, normalise: bool = True) -> DataFrame:
    """(query_id, vec_id, score, rank) of the k best of (vec_id, embedding) for (query_id, embedding, excluded)."""
    spark = vectors.sparkSession
    passes = []
    rows = vectors.where("embedding is not null").select("vec_id", A.doubles("embedding").alias("embedding"))
    for block in _blocks(queries.select("query_id", A.doubles("embedding").alias("embedding"), "excluded")):
        q = np.array([r[1] for r in block], dtype=float)
        if normalise:
            q = q / np.where((n := np.linalg.norm(q, axis=1, keepdims=True)) == 0, 1, n)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block]), q, [set(r[2] or []) for r in block]))

        def run(batches, shared=shared):
            ids, q, excluded = shared.value
            for b in batches:
                if not len(b):
                    continue
                v, at = np.stack(b["embedding"].to_numpy()), b["vec_id"].to_numpy()
                if normalise:
                    v = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
                for first in range(0, len(ids), AT_ONCE):
                    part = slice(first, first + AT_ONCE)
                    s = q[part] @ v.T
                    masked = np.where(np.isfinite(s), s, -np.inf)
                    for i, out in enumerate(excluded[part]):
                        if out:
                            masked[i, np.isin(at, list(out))] = -np.inf
                    order = np.lexsort((np.broadcast_to(at, masked.shape), -masked), axis=1)[:, :k]
                    row = np.repeat(np.arange(len(s)), order.shape[1])
                    col = order.ravel()
                    yield pd.DataFrame({"query_id": ids[part][row], "vec_id": at[col], "score": s[row, col], "masked": masked[row, col]})

        passes.append(rows.mapInPandas(run, "query_id bigint, vec_id bigint, score double, masked double"))
    if not passes:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("masked").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", r6(F.col("score")).alias("score"), "rank")


def every_hundredth(vectors: DataFrame) -> DataFrame:
    """The stated query set: the vectors whose id is divisible by 100; a query doesn't find itself."""
    return vectors.where((F.col("vec_id") % 100 == 0) & F.col("embedding").isNotNull()).select(F.col("vec_id").alias("query_id"), "embedding", F.array("vec_id").alias("excluded"))


def nearest(vectors: DataFrame, k: int = 5) -> DataFrame:
    return best(vectors, every_hundredth(vectors), k)


def analogy_queries(vectors: DataFrame) -> DataFrame:
    """a : b = c : ? for a with an id divisible by 100 and the next two vectors; the one after is expected."""
    v = vectors.select("vec_id", A.doubles("embedding").alias("e"))
    shifted = lambda k, n: v.select((F.col("vec_id") - k).alias("query_id"), F.col("e").alias(n))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("a")).join(shifted(1, "b"), "query_id").join(shifted(2, "c"), "query_id")
    moved = A.both(A.both(F.col("b"), F.col("a"), lambda x, y: x - y), F.col("c"), lambda x, y: x + y)
    ids = F.col("query_id")
    return q.select("query_id", A.unit(moved).alias("embedding"), F.array(ids, ids + 1, ids + 2).alias("excluded"))


def analogies(vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k best of b - a + c; the query has length one, the vectors are taken as they are."""
    return best(vectors, analogy_queries(vectors), k, normalise=False)


def expected_ranks(vectors: DataFrame) -> DataFrame:
    """(query_id, expected_id, expected_rank, hit_at_5): the place of the expected answer in the full order.

    Counted, not sorted: the rank is one more than the number of vectors before the expected one.
    """
    q = analogy_queries(vectors).select("query_id", F.col("embedding").alias("q"), "excluded")
    expected = vectors.select((F.col("vec_id") - 3).alias("query_id"), F.col("vec_id").alias("expected_id"), A.doubles("embedding").alias("x"))
    q = q.join(expected, "query_id").select("query_id", "q", "excluded", "expected_id", A.dot(F.col("q"), F.col("x")).alias("s"))
    spark, passes = vectors.sparkSession, []
    rows = vectors.where("embedding is not null").select("vec_id", A.doubles("embedding").alias("embedding"))
    for block in _blocks(q):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block]), [set(r[2]) for r in block], np.array([r[3] for r in block]), np.array([r[4] for r in block], dtype=float)))

        def run(batches, shared=shared):
            ids, q, excluded, expected, own = shared.value
            for b in batches:
                if not len(b):
                    continue
                v, at = np.stack(b["embedding"].to_numpy()), b["vec_id"].to_numpy()
                for first in range(0, len(ids), AT_ONCE):
                    part = slice(first, first + AT_ONCE)
                    s, mine, wanted = q[part] @ v.T, own[part, None], expected[part, None]
                    for i, out in enumerate(excluded[part]):
                        s[i, np.isin(at, list(out))] = -np.inf
                    before = ((s > mine + 1e-12) | ((np.abs(s - mine) <= 1e-12) & (at[None, :] < wanted))) & (at[None, :] != wanted)
                    yield pd.DataFrame({"query_id": ids[part], "expected_id": expected[part], "before": before.sum(axis=1)})

        passes.append(rows.mapInPandas(run, "query_id bigint, expected_id bigint, before bigint"))
    if not passes:
        return spark.createDataFrame([], "query_id bigint, expected_id bigint, expected_rank bigint, hit_at_5 boolean")
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    rank = F.sum("before") + 1
    return found.groupBy("query_id", "expected_id").agg(rank.alias("expected_rank"), (rank <= 5).alias("hit_at_5"))


def label_hits(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hits, hit): how many of the k nearest share the query's label."""
    top = nearest(vectors, k)
    labels = vectors.select("vec_id", "label")
    named = top.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    hits = F.count_if(F.col("label") == F.col("wanted"))
    return named.groupBy("query_id").agg(hits.alias("hits"), (hits > 0).alias("hit"))


def centroid_scores(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, cosine, textbook): the cosine to the mean vector of the own label, both ways of guarding zero."""
    long = vectors.where("embedding is not null").select("label", F.posexplode(A.doubles("embedding")).alias("i", "x"))
    mean = long.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("m"))
    rows = vectors.where("embedding is not null").select("vec_id", "label", A.doubles("embedding").alias("v")).join(mean, "label")
    return rows.select("vec_id", "label", r6(A.dot(A.unit(F.col("v")), A.unit(F.col("m")))).alias("cosine"), r6(A.cosine(F.col("v"), F.col("m"))).alias("textbook"))
