"""Event streams: the same windows as in batch, kept as state between micro-batches.

A stream is read from a growing folder, worked on as far as there is data, and its result is a table in the
shared folder; a restart continues from the checkpoint there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from warpline.session import shared_folder


def stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A folder or file of parquet as a stream; the rate of files bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def finished(result: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run until the input is used up and read what was written. Micro-batches are written whole, under their number, so a batch that is tried again replaces itself."""
    spark = result.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number if mode == 'append' else 0}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if (e := query.exception()) is not None:
        raise RuntimeError(str(e))
    return spark.read.schema(StructType([*result.schema.fields])).parquet(f"{root}/out/batch=*")


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(hour, event_type, events, total): tumbling windows of an hour; with ``late`` events beyond that delay are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if late else rows
    return rows.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds(F.col("window.start")).alias("hour"), "event_type", "events", "total")


CLOSED = "user_id bigint, window bigint, events bigint, total double"


def closed_windows(events: DataFrame, closing: str = "purchase") -> DataFrame:
    """(user_id, window, events, total) as a stream: stretches of a user's events up to a closing one.

    The state is three numbers a user, whatever the length of the open stretch; users aren't forgotten.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        value, closes = rows["value"].fillna(0.0).to_numpy(float), (rows["event_type"] == closing).to_numpy()
        # the number of closing events before each one is its window, counted from the open one
        window = np.cumsum(closes) - closes
        done = int(closes.sum())
        counts, sums = np.bincount(window, minlength=done + 1), np.bincount(window, value, minlength=done + 1)
        counts[0] += n
        sums[0] += total
        out = [(key[0], number + k, int(counts[k]), round(float(sums[k]), 4)) for k in range(done)]
        number, n, total = number + done, int(counts[done]), float(sums[done])
        state.update((number, n, total))
        yield pd.DataFrame(out, columns=["user_id", "window", "events", "total"])

    return events.groupBy("user_id").applyInPandasWithState(advance, CLOSED, "number bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)


POINTS = "run_id string, point bigint, last_update bigint, unit_count bigint, mean double"


def every_n_points(updates: DataFrame, every: int = 10) -> DataFrame:
    """(run_id, point, last_update, unit_count, mean) as a stream of updates in their order: a point after the first and every ``every`` further ones."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, n, units, total = state.get if state.exists else (0, -1, 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("update_no").drop_duplicates("update_no")
        rows = rows[(rows["update_no"] > last) & np.isfinite(rows["loss"].to_numpy(float))]
        out = []
        if len(rows):
            loss, size, update = rows["loss"].to_numpy(float), rows["batch_size"].to_numpy(), rows["update_no"].to_numpy()
            # the updates with a number divisible by ``every`` end a point
            place = seen + np.arange(len(rows))
            ends = place % every == 0
            point = np.cumsum(ends) - ends
            done = int(ends.sum())
            counts, sums = np.bincount(point, minlength=done + 1), np.bincount(point, loss, minlength=done + 1)
            sizes = np.bincount(point, size.astype(float), minlength=done + 1).astype(int)
            counts[0], sums[0], sizes[0] = counts[0] + n, sums[0] + total, sizes[0] + units
            out = [(key[0], int(p // every), int(u), int(sizes[k]), float(sums[k] / counts[k])) for k, (p, u) in enumerate(zip(place[ends], update[ends], strict=True))]
            seen, last, n, units, total = seen + len(rows), int(update[-1]), int(counts[done]), int(sizes[done]), float(sums[done])
        state.update((seen, last, n, units, total))
        yield pd.DataFrame(out, columns=["run_id", "point", "last_update", "unit_count", "mean"])

    return updates.groupBy("run_id").applyInPandasWithState(advance, POINTS, "seen bigint, last bigint, n bigint, units bigint, total double", "append", GroupStateTimeout.NoTimeout)
