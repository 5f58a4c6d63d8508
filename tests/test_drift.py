import json
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from warpline.operators import drift

FIELDS = [("a", x, t) for x, t in {"id": "string", "n": "integer", "x": "number", "o": "object", "o/deep": "integer", "items": "array", "items[]/name_of": "string", "items[]/bytes": "integer", "o/max_size": "integer"}.items()]
FULL = {"id": "i", "n": 1, "x": 1, "o": {"deep": 2, "max_size": 3}, "items": [{"name_of": "p", "bytes": 4}]}


def changed(**more):
    return json.loads(json.dumps(FULL)) | more


CASES = [
    (FULL, set()),
    (changed(extra=[1]), {("extra", "added")}),
    (changed(extra={"below": 1}), {("extra", "added")}),
    ({k: v for k, v in FULL.items() if k != "x"}, {("x", "removed")}),
    (changed(n=1.5), {("n", "retyped")}),
    (changed(n="1"), {("n", "retyped")}),
    (changed(n=None, o=None), set()),
    (changed(x=float("nan")), set()),
    (changed(o=[{"deep": 1}]), {("o", "retyped")}),
    (changed(o={"deep": 2, "maxSize": 3}), {("o/max_size", "renamed")}),
    (changed(o={"deep": 2}) | {"max_size": 3}, {("o/max_size", "renamed")}),
    (changed(items=[]), set()),
    ({k: v for k, v in changed(other={"id": "q"}).items() if k != "id"}, {("id", "removed"), ("other", "added")}),
    (changed(items=[{"name_of": "p", "nbytes": 1}, {"name_of": "q", "nbytes": 2}]), {("items[]/bytes", "renamed")}),
    (changed(items=[{"name_of": "p"}]), {("items[]/bytes", "removed")}),
]


@pytest.mark.parametrize("value, expected", CASES)
def test_departures(value, expected):
    wanted = {f: t for _, f, t in FIELDS}
    assert set(drift.departures(drift.shape_of(drift.parsed(json.dumps(value))), wanted, "a")[0]) == expected


@pytest.fixture
def tables(spark):
    at = datetime(2024, 1, 1)
    good = json.dumps(FULL)
    texts = [good, "﻿ " + good, good, None, "", "[1]", "{", '{"a": 1} x', json.dumps(changed(n="7", extra=1)), '{"x": NaN, "id": "z"}', "[" * 5000]
    files = spark.createDataFrame([(i, "a", at, t, "clash") for i, t in enumerate(texts)] + [(0, "a", at, good, "clash"), (90, "unknown", at, '{"q": 1}', ""), (91, None, at, "{}", "")], "file_id bigint, record_kind string, written_at timestamp_ntz, payload string, path string")
    return files, spark.createDataFrame(FIELDS, "record_kind string, field string, json_type string")


def test_found(tables):
    got = rows(drift.found(*tables))
    for bad in (3, 4, 5, 6, 7, 10):
        assert {r for r in got if r[0] == bad} == {(bad, "", "unreadable")}
    assert not [r for r in got if r[0] in (0, 1, 2, 91)]
    assert {r[1:] for r in got if r[0] == 8} == {("n", "retyped"), ("extra", "added")}
    assert (90, "q", "added") in got
    assert {r[1:] for r in got if r[0] == 9} == {(f, "removed") for f in ("n", "o", "o/deep", "o/max_size", "items", "items[]/name_of", "items[]/bytes")}


def test_table_and_union(tables):
    files, fields = tables
    table = {r["file_id"]: r for r in drift.consistent_table(files, fields, "a").collect()}
    assert table[8]["n"] == 7 and table[0]["items[]/bytes"] == [4] and table[0]["o/deep"] == 2
    assert table[8]["unfit"] == {} and 3 not in table
    assert table[8]["added"] == {"extra": "1"} and table[0]["added"] == {}
    kinds = {(r["record_kind"], r["path"]): r["json_type"] for r in drift.union_schema(files).collect()}
    assert kinds["a", "n"] == "any" and kinds["a", "x"] == "number" and kinds["a", "o/deep"] == "integer"
    log = drift.change_log(files, fields).where("change = 'unreadable'").collect()
    assert log[0]["files"] == 6


def test_a_change_of_type_moves_the_union_and_the_log_alike(spark):
    at = datetime(2024, 1, 1)
    files = lambda *payloads: spark.createDataFrame([(i, "a", at, json.dumps(p)) for i, p in enumerate(payloads)], "file_id bigint, record_kind string, written_at timestamp_ntz, payload string")
    fields = spark.createDataFrame([("a", "n", "integer")], "record_kind string, field string, json_type string")
    for payloads, union, log in (([{"n": 1}, {"n": 2}], "integer", set()), ([{"n": 1}, {"n": 2.5}], "number", {("n", "retyped", 1)}), ([{"n": 1}, {"n": "2"}, {"n": 2.5}], "any", {("n", "retyped", 2)})):
        assert rows(drift.union_schema(files(*payloads)).select("path", "json_type", "files")) == {("n", union, len(payloads))}
        assert rows(drift.change_log(files(*payloads), fields).select("field", "change", "files")) == log


def test_added_fields_keep_the_type_of_the_union_and_files_in_two_shapes_count_once(spark):
    at = datetime(2024, 1, 1)
    files = spark.createDataFrame([(1, "a", at, '{"n": 1, "q": 2}'), (2, "a", at, '{"n": 1, "q": 2.5}'), (2, "a", at, '{"n": 1}'), (3, "a", at, '{"q": {"z": 1}, "n": 1}'), (3, "a", at, '{"q": {"z": 1}, "n": 1}')], "file_id bigint, record_kind string, written_at timestamp_ntz, payload string")
    fields = spark.createDataFrame([("a", "n", "integer")], "record_kind string, field string, json_type string")
    assert {(r["path"], r["json_type"], r["files"]) for r in drift.union_schema(files).collect()} == {("n", "integer", 3), ("q", "any", 3), ("q/z", "integer", 1)}
    only = {r["file_id"]: r["added"] for r in drift.consistent_table(files.where("file_id = 1 or file_id = 2 and payload like '%2.5%'"), fields, "a").collect()}
    assert only == {1: {"q": "2.0"}, 2: {"q": "2.5"}}


def test_of_equally_like_names_the_type_over_all_files_decides():
    wanted, shape = {"max_size": "number"}, {"size_max_a": "integer", "size_max_b": "integer"}
    assert drift.departures(shape, wanted, "k", {"size_max_a": "any", "size_max_b": "number"})[1] == {"max_size": "size_max_b"}
    assert drift.departures(shape, wanted, "k", {"size_max_a": "number", "size_max_b": "any"})[1] == {"max_size": "size_max_a"}


def test_very_long_integers_stay_integers():
    assert drift.shape_of(drift.parsed('{"n": ' + "9" * 5000 + "}")) == {"n": "integer"}


def test_empty(tables):
    files, fields = tables
    assert drift.found(files.limit(0), fields).count() == 0
    assert drift.found(files.where("file_id = 0"), fields.limit(0)).count() == 5
    assert drift.union_schema(files.limit(0)).count() == 0


names = st.sampled_from(drift.TYPES + ("any",))


@given(names, names, names)
def test_lattice(a, b, c):
    j = drift.joined
    assert j(a, b) == j(b, a) and j(a, j(b, c)) == j(j(a, b), c) and j(a, a) == a
