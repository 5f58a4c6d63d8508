import gzip
import sqlite3
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows

from warpline.sources import artifacts, sinks
from warpline.streaming import events as E


def test_csv(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("0", "valid", "3.0"), ("1", "train", None)], "step string, split string, value string"), f"{tmp_path}/c")
    got = artifacts.csv_rows(spark, f"{tmp_path}/c", ["step", "split", "value", "absent"])
    assert rows(got) == {("0", "valid", "3.0", None), ("1", "train", None, None)}
    assert artifacts.csv_rows(spark, f"{tmp_path}/none", ["a"]).count() == 0


def test_bundles_images_listing(spark, tmp_path):
    np.savez(tmp_path / "w.npz", W=np.arange(6.0).reshape(2, 3), b=np.zeros(2))
    got = {r["name"]: (r["shape"], r["values"]) for r in artifacts.arrays(spark, f"{tmp_path}/w.npz").collect()}
    assert got == {"W": ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), "b": ([2], [0.0, 0.0])}
    again = spark.createDataFrame([("m", n, s, v) for n, (s, v) in got.items()], "bundle string, name string, shape array<bigint>, values array<double>")
    assert sinks.write_bundles(again, f"{tmp_path}/out").collect()[0]["arrays"] == 2
    assert {r["name"]: (r["shape"], r["values"]) for r in artifacts.arrays(spark, f"{tmp_path}/out/m.npz").collect()} == got
    image = np.arange(12, dtype=np.uint8).reshape(3, 2, 2) + 244
    (tmp_path / "i.gz").write_bytes(gzip.compress(bytes([0, 0, 8, 3]) + struct.pack(">3I", 3, 2, 2) + image.tobytes()))
    assert [r["values"] for r in artifacts.idx_rows(spark, f"{tmp_path}/i.gz").orderBy("id").collect()] == image.reshape(3, 4).tolist()
    assert artifacts.listing(spark, str(tmp_path)).count() == 3


def test_text_and_sqlite(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" the  cat\nsat \n")
    assert [r["word"] for r in artifacts.text_tokens(spark, f"{tmp_path}/t.txt").orderBy("line", "pos").collect()] == ["the", "cat", "<eos>", "sat", "<eos>"]
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE kernels (id INTEGER, name TEXT, ms REAL)")
        db.executemany("INSERT INTO kernels VALUES (?, ?, ?)", [(i, f"k{i}", i / 2) for i in range(100)])
        db.execute("CREATE TABLE empty (id INTEGER)")
    assert rows(artifacts.sqlite_table(spark, f"{tmp_path}/t.db", "kernels")) == {(i, f"k{i}", i / 2) for i in range(100)}
    assert artifacts.sqlite_table(spark, f"{tmp_path}/t.db", "empty").count() == 0 and artifacts.sqlite_table(spark, f"{tmp_path}/t.db", "none").count() == 0


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "k string, v int")
    path = f"{tmp_path}/rows"
    for df in (a, b, a):
        sinks.append_new(df, path, ["k"])
    assert rows(spark.read.parquet(path)) == {("x", 1), ("y", 2), ("z", 3)}
    assert rows(sinks.upsert_plan(spark.createDataFrame([("x", 1), ("y", 9), ("q", 1)], "k string, v int"), a, ["k"], "v")) == {("x", "same"), ("y", "conflict"), ("q", "insert")}
    assert rows(sinks.imported(b, a, ["k"], "v")) == {("z", 3)}
    with pytest.raises(ValueError):
        sinks.imported(spark.createDataFrame([("y", 9)], "k string, v int"), a, ["k"], "v")
    sinks.publish(a, f"{tmp_path}/pub")
    with pytest.raises(FileExistsError):
        sinks.publish(b, f"{tmp_path}/pub")
    listed = sinks.manifest(spark, f"{tmp_path}/pub")
    assert {r["state"] for r in sinks.verified(listed, listed).collect()} == {"ok"}
    for g in range(5):
        assert rows(sinks.write_generation(spark.createDataFrame([(g,)], "g int"), f"{tmp_path}/gen", g, keep=2)) == {(g,)}
    assert [r["g"] for r in sinks.latest_generation(spark, f"{tmp_path}/gen").collect()] == [4]
    assert sorted(p.name for p in (tmp_path / "gen").iterdir() if not p.name.startswith(".")) == ["generation=00000003", "generation=00000004"]
    shape = "name string, shape array<int>"
    assert rows(sinks.parameter_mismatches(spark.createDataFrame([("w", [1]), ("b", [2]), ("x", [1])], shape), spark.createDataFrame([("w", [1]), ("b", [3]), ("y", [1])], shape))) == {("b", "shape"), ("x", "unexpected"), ("y", "missing")}


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
T0 = datetime(2024, 1, 1)


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    from warpline.operators.runs import trigger_windows

    kinds = ["view", "purchase", "click"]
    data = [(i, T0 + timedelta(minutes=7 * i), i % 3, kinds[(i * 7) % 3] if i % 5 else "purchase", float(i), "{}") for i in range(120)]
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(4):
        spark.createDataFrame(data[k * 30 : k * 30 + 30], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
    batch = spark.createDataFrame(data, EVENTS)
    one_by_one = lambda: E.stream(spark, f"{tmp_path}/events.parquet", batch.schema, files_per_batch=1)
    got = E.finished(E.closed_windows(one_by_one()))
    want = {(r["user_id"], r["window"], r["events"], r["total"]) for r in trigger_windows(batch).where("closed = 1").collect()}
    assert rows(got.select("user_id", "window", "events", "total")) == want and want
    hours = E.finished(E.hourly(one_by_one()), "complete").select("hour", "event_type", "events", "total")
    assert rows(hours) == rows(E.hourly(batch))


