"""Draws from powered unigram distributions and splits, repeatable by hashing instead of generator streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warpline.session import settled

#: Words whose distribution is sent to the executors at most, 24 bytes each.
WORDS_SENT = 2_000_000
_BELOW_ONE = 1 - 2.0**-53


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def digest_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """The same by an MD5 digest, so that other engines can draw the same numbers; slower than ``uniform``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def drawn(rows: DataFrame, keys: list[str], distribution: DataFrame, negatives: int, target: str, seed: int = 0) -> DataFrame:
    """rows with ``draw`` and ``negative``: that many exact draws a row, never the row's target, by inverting the conditional cdf.

    ``distribution``: (word_id, p, low, cdf). The point ``u (1 - p_t)`` is moved past the target's interval, then found in
    the cdf: of at most ``WORDS_SENT`` words by a search in the array, which is sent along, so that no row is shuffled; of
    more by a join on the point's cell, with at least as many cells as words. Both give the same draws. Rows whose
    target isn't among the words, or is null, have none.
    """
    distribution = settled(distribution.where("cdf > low").select("word_id", "low", "cdf"))
    n = distribution.count()
    us = [uniform(*keys, F.lit(k), seed=seed) for k in range(1, negatives + 1)]
    if n <= WORDS_SENT:
        words = distribution.orderBy("low").toPandas()  # at most WORDS_SENT rows of three numbers
        by_id = words.sort_values("word_id")
        shared = rows.sparkSession.sparkContext.broadcast([words[c].to_numpy() for c in ("word_id", "cdf")] + [by_id[c].to_numpy() for c in ("word_id", "low", "cdf")])
        names = rows.columns
        draw = pa.array(np.arange(1, negatives + 1, dtype=np.int32))

        def run(batches):
            ids, cdf, known, low, high = shared.value
            for b in batches:
                own = b.column(target).to_numpy(zero_copy_only=False)
                own = np.where(b.column(target).is_null().to_numpy(zero_copy_only=False), -1, own).astype(np.int64)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                there = np.flatnonzero(known[at] == own) if len(known) else np.zeros(0, np.int64)
                b, at = b.take(pa.array(there)), at[there]
                u = np.stack([b.column(f"_u{k}").to_numpy() for k in range(negatives)], 1) if len(there) else np.zeros((0, negatives))
                pt, lt = (high[at] - low[at])[:, None], low[at][:, None]
                point = u * (1 - pt)
                point = np.minimum(np.where(point < lt, point, point + pt), _BELOW_ONE)
                found = ids[np.minimum(np.searchsorted(cdf, point, side="right"), max(len(ids) - 1, 0))] if len(ids) else np.zeros((0, negatives), np.int64)
                again = b.select(names).take(pa.array(np.repeat(np.arange(len(there)), negatives)))
                yield pa.RecordBatch.from_arrays([*again.columns, draw.take(pa.array(np.tile(np.arange(negatives), len(there)))), pa.array(found.ravel().astype(np.int64))], names=[*names, "draw", "negative"])

        schema = T.StructType([*rows.schema.fields, T.StructField("draw", T.IntegerType()), T.StructField("negative", T.LongType())])
        return rows.select("*", *[u.alias(f"_u{k}") for k, u in enumerate(us)]).mapInArrow(run, schema)
    cells = 1 << n.bit_length()
    own = distribution.select(F.col("word_id").alias(target), (F.col("cdf") - F.col("low")).alias("_pt"), F.col("low").alias("_lt"))
    draws = rows.select("*", F.posexplode(F.array(*us)).alias("draw", "_u")).withColumn("draw", F.col("draw") + 1).join(own, target)
    u = F.col("_u") * (1 - F.col("_pt"))
    draws = draws.withColumn("_u", F.least(F.when(u < F.col("_lt"), u).otherwise(u + F.col("_pt")), F.lit(_BELOW_ONE))).drop("_pt", "_lt")
    place = lambda c: F.floor(c * cells).cast("bigint")
    cut = distribution.select(F.col("word_id").alias("negative"), F.col("low").alias("_low"), F.col("cdf").alias("_high"), F.explode(F.sequence(place(F.col("low")), place(F.col("cdf")))).alias("_cell"))
    found = draws.withColumn("_cell", place(F.col("_u"))).join(cut, "_cell").where((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_high")))
    return found.select(*rows.columns, "draw", "negative")


def rejected(rows: DataFrame, keys: list[str], target: str, words: int, negatives: int, rounds: int = 3, seed: int = 0) -> DataFrame:
    """rows with ``draw`` and ``negative``: uniform words, drawn anew if the target comes, for so many rounds, and then the word after it."""
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(negatives))))
    pick = F.pmod(F.col(target) + 1, F.lit(words))
    for r in reversed(range(rounds)):
        word = F.floor(digest_uniform(*keys, "draw", F.lit(r), seed=seed) * words)
        pick = F.when(word != F.col(target), word).otherwise(pick)
    return draws.withColumn("negative", pick.cast("bigint"))


def without_replacement(distribution: DataFrame, key: str, weight: str, k: int, seed: int = 0) -> DataFrame:
    """k different ids, drawn in proportion to their weights (exponential races)."""
    race = -F.ln(digest_uniform(key, seed=seed) + 1e-300) / F.col(weight)
    return distribution.where(F.col(weight) > 0).withColumn("race", race).orderBy("race", key).limit(k).drop("race")


def split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 0) -> DataFrame:
    """rows with ``split``: 'test' for the last ``floor(n * share)`` of the rows, shuffled by the digests of their keys, 'train' for the others.

    Rows are counted by the leading digits of their digests; only those of the one count in which the cut lies are
    ordered. Keys are unique; equal ones are ordered as they come.
    """
    told = rows.withColumns({"_h": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))}).withColumn("_b", F.substring("_h", 1, 4))
    counts = settled(told.groupBy("_b").agg(F.count("*").alias("n")))  # at most 65,536 rows
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train = n - int(n * share)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = before.where((F.col("before") <= train) & (F.col("before") + F.col("n") > train)).first()
    if cut is None:  # all or nothing is for training
        return told.drop("_h", "_b").withColumn("split", F.lit("train"))
    inside = told.where(F.col("_b") == cut["_b"]).withColumn("_r", F.row_number().over(Window.orderBy("_h", key)) - 1 + cut["before"])
    inside = inside.withColumn("split", F.when(F.col("_r") >= train, "test").otherwise("train")).drop("_r")
    outside = told.where(F.col("_b") != cut["_b"]).withColumn("split", F.when(F.col("_b") > cut["_b"], "test").otherwise("train"))
    return outside.unionByName(inside).drop("_h", "_b")


def shuffled(rows: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """rows with ``place`` from 0 in a repeatable random order within each group."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("place", F.row_number().over(order) - 1)


def batches(placed: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """rows with ``batch``; with ``drop_last`` without those of an incomplete one. ``placed`` has place and n, the group's rows."""
    b = F.floor(F.col("place") / size).cast("bigint")
    rows = placed.withColumn("batch", b)
    return rows.where(F.col("batch") < F.floor(F.col("n") / size)) if drop_last else rows
