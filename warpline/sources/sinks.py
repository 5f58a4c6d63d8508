"""Writers: CSV, incremental rows, array bundles, manifests, published folders and generations."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from warpline.sources.artifacts import exists


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header; an empty frame writes its header only."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key isn't stored yet; writing the same rows again changes nothing."""
    rows = df.dropDuplicates(keys)
    if exists(df.sparkSession, path):
        stored = df.sparkSession.read.parquet(path).select(*keys)
        rows = rows.join(stored, keys, "left_anti")
    rows.write.mode("append").parquet(path)


def upsert_plan(new: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, action): ``insert``, ``same`` or ``conflict`` of each new row against the stored ones."""
    both = new.select(*keys, F.col(value).alias("_new")).join(stored.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there")), keys, "left")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_new").eqNullSafe(F.col("_old")), "same").otherwise("conflict")
    return both.select(*keys, action.alias("action"))


def imported(new: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows to insert; a conflict raises, with how many there are."""
    plan = upsert_plan(new, stored, keys, value)
    if (n := plan.where("action = 'conflict'").count()) > 0:
        raise ValueError(f"{n} rows are stored with another value")
    return new.join(plan.where("action = 'insert'").select(*keys), keys, "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, sha256) of the files below a folder, relative to it, digested where they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    relative = F.expr(f"substr(path, instr(path, '{path.rstrip('/').removeprefix('file:')}') + {len(path.rstrip('/').removeprefix('file:')) + 1})")
    return rows.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): ``ok``, ``changed``, ``missing`` or ``unlisted``."""
    both = listed.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") == F.col("b"), "ok").otherwise("changed")
    return both.select("path", state.alias("state"))


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target, then rename in one step: readers see the old folder or the new one, with its ``_SUCCESS``."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    target, fs = _files(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    if not fs.rename(_files(spark, staging)[0], target):
        raise OSError(f"{staging} could not be renamed to {path}")


def write_generation(df: DataFrame, root: str, generation: int, keep: int = 3) -> DataFrame:
    """Write a generation, then drop all but the last ``keep``; the newest complete one is what ``latest_generation`` reads."""
    spark = df.sparkSession
    publish(df, f"{root}/generation={generation:08d}")
    path, fs = _files(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("generation="))
    for name in names[:-keep]:
        fs.delete(_files(spark, f"{root}/{name}")[0], True)
    return latest_generation(spark, root)


def latest_generation(spark: SparkSession, root: str) -> DataFrame:
    path, fs = _files(spark, root)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("generation=") and fs.exists(_files(spark, f"{root}/{s.getPath().getName()}/_SUCCESS")[0]))
    return spark.read.parquet(f"{root}/{names[-1]}")


def write_bundles(rows: DataFrame, path: str) -> DataFrame:
    """(bundle, arrays, size_bytes): one NPZ per bundle of (bundle, name, shape, values), each written by the task that holds it.

    A bundle, like a model's parameters, is written as one file and so by one task.
    """

    def write(pdf):
        import os

        import pandas as pd

        buffer = io.BytesIO()
        np.savez(buffer, **{r.name: np.array(r["values"], float).reshape([int(x) for x in r["shape"]]) for _, r in pdf.set_index("name", drop=False).iterrows()})
        bundle = pdf["bundle"].iloc[0]
        os.makedirs(path, exist_ok=True)
        temporary = f"{path}/.{bundle}-{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            f.write(buffer.getvalue())
        os.replace(temporary, f"{path}/{bundle}.npz")
        return pd.DataFrame({"bundle": [bundle], "arrays": [len(pdf)], "size_bytes": [buffer.tell()]})

    return rows.groupBy("bundle").applyInPandas(write, "bundle string, arrays bigint, size_bytes bigint")


def parameter_mismatches(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, problem): names on one side only and differing shapes of (name, shape)."""
    both = saved.select("name", F.col("shape").alias("a")).join(wanted.select("name", F.col("shape").alias("b")), "name", "full_outer")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").when(F.col("a") != F.col("b"), "shape")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def retained(rows: DataFrame, group: list[str], name: str, keep: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(name).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
