"""Records whose shape drifts from file to file, read into one table per kind.

The shape of every file (its field paths and JSON types) is read in parallel and written down once, a narrow row
a file. All the rest works on the distinct shapes, which grow more slowly than the files (920 in 3,000 files of the test
data, 4,380 in 30,000); equal ones meet in the map-side combine. They fold through a lattice of types (``null`` below
everything, ``integer`` below ``number``, ``any`` above everything), one aggregation over bit masks, to the union schema.
Each distinct shape, joined with the union schema, is held against the wanted schema once: fields that moved to another name or place
are found among its absent and extra fields by the words of their names (``SAME_WORD`` maps the words that mean one
thing), and of equally likely ones by the type that they have over all files. The changes of a file are those of
its shape. Values are cast to the wanted type; fields that the wanted schema lacks are kept in the type of the union schema.

Defined results: a null, empty or broken payload, a JSON value that isn't an object, and objects
nested deeper than the parser's limit are ``unreadable``. A file of a kind that the schema doesn't
have departs from it by every field. An empty array says nothing about its elements. Of a key that
stands twice in one object the last counts. Exact copies of a file report each change once.
"""

from __future__ import annotations

import decimal
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warpline.session import if_small, settled

TYPES = ("null", "boolean", "integer", "number", "string", "object", "array")
#: Words of field names that stand for one thing; fixed values, extend per project.
SAME_WORD = {
    "cmd": "command", "op": "action", "nbytes": "bytes", "identifier": "id", "name": "id",
    "digest": "sha256", "checksum": "sha256", "end": "finished", "completed": "finished", "ended": "finished",
    "generated": "created", "written": "created", "time": "at", "on": "at", "learning_rate": "lr",
}
LEAST_LIKENESS = 0.5
#: Distinct shapes whose changes are broadcast at most.
SHAPES_AT_ONCE = 20_000


class _Unreadable(ValueError):
    pass


def _integer(literal: str):
    return int(literal) if len(literal) < 4000 else decimal.Decimal(literal)  # longer than Python's limit for int()


def parsed(payload: str | None) -> dict:
    if payload is None:
        raise _Unreadable
    try:
        value = json.loads(payload.removeprefix("﻿").strip(), parse_int=_integer)
    except (ValueError, RecursionError):
        raise _Unreadable from None
    if not isinstance(value, dict):
        raise _Unreadable
    return value


def type_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", decimal.Decimal: "integer", float: "number", str: "string", dict: "object"}.get(type(value), "array")


def joined(a: str, b: str) -> str:
    """The least type of the lattice that holds both."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    return "number" if {a, b} == {"integer", "number"} else "any"


def holds(wanted: str, found: str) -> bool:
    """Whether a value of the type ``found`` needs no change to stand in a field of the type ``wanted``."""
    return joined(wanted, found) == wanted


def shape_of(value: dict) -> dict[str, str]:
    """Path -> type. ``/`` steps into an object, ``[]`` into the elements of an array."""
    shape: dict[str, str] = {}
    todo = [("", value)]
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            below = [(f"{at}/{k}" if at else k, x) for k, x in v.items()]
            for path, x in below:
                shape[path] = joined(shape.get(path, "null"), type_of(x))
            todo += below
        elif isinstance(v, list):
            todo += [(f"{at}[]", x) for x in v if isinstance(x, (dict, list))]
    return shape


def parents(path: str, known: Iterable[str]) -> Iterator[str]:
    known = set(known)
    for m in re.finditer(r"\[\]|/", path):
        if path[: m.start()] in known:
            yield path[: m.start()]


def words(path: str, kind: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of a path, and those of its last step; a kind's own name says nothing."""

    def split(text: str) -> list[str]:
        text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text).lower()
        text = re.sub(r"[^a-z0-9]+", "_", text).strip("_").replace("learning_rate", "lr")
        return [SAME_WORD.get(w, w) for w in text.split("_") if w and w != kind]

    return frozenset(split(path)), frozenset(split(path.rpartition("/")[2]))


def renames(extra: dict[str, str], absent: dict[str, str], kind: str, union: dict[str, str]) -> dict[str, str]:
    """Absent field -> the field of the file that carries its content.

    Both lie in the same array (or none), the type fits, the last steps share a word, and the words of
    both paths agree at least to ``LEAST_LIKENESS`` (shared over all). The likest pairs are taken first, of equally
    like ones those of the wanted type over all files (``union``).
    """
    likely = []
    for a, wanted in absent.items():
        all_a, last_a = words(a, kind)
        for e, found in extra.items():
            if a.count("[]") != e.count("[]") or a.rpartition("[]")[0] != e.rpartition("[]")[0] or not holds(wanted, found):
                continue
            all_e, last_e = words(e, kind)
            score = len(all_a & all_e) / max(1, len(all_a | all_e))
            if score >= LEAST_LIKENESS and (last_a & all_e or last_e & all_a):
                likely.append((-score, union.get(e, found) != wanted, a, e))
    chosen: dict[str, str] = {}
    for *_, a, e in sorted(likely):
        if a not in chosen and e not in chosen.values():
            chosen[a] = e
    return chosen


def departures(shape: dict[str, str], wanted: dict[str, str], kind: str, union: dict[str, str] | None = None) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """(field, change) of one shape in order, and where the renamed fields stand."""
    retyped = [p for p, t in shape.items() if p in wanted and not holds(wanted[p], t)]
    hidden = {p for p in shape if any(True for _ in parents(p, retyped))}
    null = [p for p, t in shape.items() if t == "null" and p in wanted]
    mute = {p for p in wanted if any(True for _ in parents(p, [*retyped, *null]))}
    # an array without objects in it says nothing about its elements
    mute |= {p for p in wanted if "[]" in p and (a := p.partition("[]")[0]) in shape and not any(q.startswith(f"{a}[]") for q in shape)}
    extra = {p: t for p, t in shape.items() if p not in wanted and p not in hidden}
    absent = {p: t for p, t in wanted.items() if p not in shape and p not in mute}
    # what lies below a field that the schema lacks belongs to that field
    extra = {p: t for p, t in extra.items() if not any(True for _ in parents(p, extra))}
    moved = renames(extra, absent, kind, union or {})
    added = [p for p in extra if p not in moved.values()]
    changes = [(p, "retyped") for p in retyped if not any(True for _ in parents(p, [r for r in retyped if r != p]))]
    changes += [(p, "renamed") for p in moved] + [(p, "removed") for p in absent if p not in moved] + [(p, "added") for p in added]
    return sorted(changes), moved


def _wanted(schema_fields: DataFrame) -> dict[str, dict[str, str]]:
    """The wanted schema is a table of fixed size (one row per field of a kind), so the driver may hold it."""
    fields: dict[str, dict[str, str]] = {}
    for r in schema_fields.select("record_kind", "field", "json_type").dropDuplicates().toLocalIterator():
        fields.setdefault(r[0], {})[r[1]] = r[2]
    return fields


SHAPES = "file_id bigint, record_kind string, written_at timestamp_ntz, shape_key string, shape string"


def _key_of(kind: str | None, shape: str) -> str:
    return hashlib.blake2b(f"{kind}\0{shape}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _told(kind: str | None, payload: str | None) -> tuple[str | None, str | None]:
    """(key, shape) of a payload, nulls for an unreadable one. A shape is written as a JSON object in the order of its paths."""
    try:
        shape = json.dumps(shape_of(parsed(payload)), sort_keys=True)
    except _Unreadable:
        return None, None
    return _key_of(kind, shape), shape


def file_shapes(files: DataFrame) -> DataFrame:
    """(file_id, record_kind, written_at, shape_key, shape) of every file, without a shuffle; nulls for an unreadable one."""

    def run(batches):
        for b in batches:
            kinds = b.column("record_kind").to_pylist()
            told = [_told(k, p) for k, p in zip(kinds, b.column("payload").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("file_id", "record_kind", "written_at")], pa.array([k for k, _ in told], pa.string()), pa.array([x for _, x in told], pa.string())], names=["file_id", "record_kind", "written_at", "shape_key", "shape"])

    return _narrow(files).mapInArrow(run, SHAPES)


def _fields(shapes: DataFrame) -> DataFrame:
    """A row of each field of the shapes: their columns, path, mask (the bit of the type)."""
    code = F.create_map(*[F.lit(x) for i, t in enumerate((*TYPES, "any")) for x in (t, 1 << i)])
    rest = [c for c in shapes.columns if c != "shape"]
    told = shapes.select(*rest, F.explode(F.from_json("shape", "map<string,string>")).alias("path", "json_type"))
    return told.select(*rest, "path", F.element_at(code, F.col("json_type")).alias("mask"))


def _type_of_mask(mask: Column) -> Column:
    bare = mask.bitwiseAND(F.lit(~1))
    kind = F.when(bare == 0, "null").when(bare == 12, "number")
    for i, t in enumerate(TYPES[1:], 1):
        kind = kind.when(bare == (1 << i), t)
    return kind.otherwise("any")


def distinct_shapes(shapes: DataFrame) -> DataFrame:
    """(record_kind, shape_key, shape) of the shapes that occur."""
    return shapes.where("shape is not null").groupBy("record_kind", "shape_key").agg(F.min("shape").alias("shape"))


def folded(distinct: DataFrame) -> DataFrame:
    """(record_kind, path, json_type): the least types that hold the fields of all files."""
    return _fields(distinct).groupBy("record_kind", "path").agg(_type_of_mask(F.bit_or("mask")).alias("json_type"))


def _narrow(files: DataFrame) -> DataFrame:
    return files.select(F.col("file_id").cast("bigint"), "record_kind", F.col("written_at").cast("timestamp_ntz").alias("written_at"), "payload")


def union_schema(files: DataFrame) -> DataFrame:
    """(record_kind, path, json_type, files, first_seen, last_seen): the shapes of all files, folded through the lattice.

    ``files`` counts a file once, however often it was delivered. Files of one shape, nearly all, are counted by their shape;
    only those that came in several shapes are counted field by field.
    """
    ends = [F.min("written_at").alias("first_seen"), F.max("written_at").alias("last_seen")]
    shapes = settled(file_shapes(files).where("shape is not null"))
    one = shapes.groupBy("record_kind", "file_id").agg(F.min("shape_key").alias("shape_key"), F.max("shape_key").alias("other"), *ends)
    merge = [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    by_shape = one.where("shape_key = other").groupBy("shape_key").agg(F.count("*").alias("files"), *merge)
    counted = _fields(distinct_shapes(shapes).join(by_shape, "shape_key")).drop("shape_key")
    several = one.where("shape_key <> other").select("file_id", F.coalesce("record_kind", F.lit("")).alias("k"), F.col("record_kind").isNull().alias("no"))
    again = shapes.withColumns({"k": F.coalesce("record_kind", F.lit("")), "no": F.col("record_kind").isNull()}).join(several, ["file_id", "k", "no"], "left_semi").drop("k", "no", "shape_key")
    again = _fields(again).groupBy("record_kind", "path", "file_id").agg(F.bit_or("mask").alias("mask"), *ends).withColumn("files", F.lit(1).cast("bigint")).drop("file_id")
    seen = counted.unionByName(again).groupBy("record_kind", "path").agg(F.bit_or("mask").alias("mask"), F.sum("files").alias("files"), *merge)
    return seen.select("record_kind", "path", _type_of_mask(F.col("mask")).alias("json_type"), "files", "first_seen", "last_seen")


def shape_changes(shapes: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(shape_key, changes, moved, extra) of every distinct shape: its departures, where renamed fields stand, and its added fields with their types in the union schema."""
    wanted = _wanted(schema_fields)
    distinct = distinct_shapes(shapes)
    types = folded(distinct).withColumnRenamed("json_type", "over_all").alias("u")
    told = distinct.select("record_kind", "shape_key", F.explode(F.from_json("shape", "map<string,string>")).alias("path", "json_type")).alias("t")
    same = F.col("t.record_kind").eqNullSafe(F.col("u.record_kind")) & (F.col("t.path") == F.col("u.path"))
    # at most one row for each field of the shape
    rows = told.join(types, same).groupBy("t.record_kind", "t.shape_key").agg(F.collect_list(F.struct("t.path", "t.json_type", "u.over_all")).alias("fields"))
    bare = distinct.where("shape = '{}'").select("record_kind", "shape_key", F.array().cast(rows.schema["fields"].dataType).alias("fields"))

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], []]
            for kind, key, fields in zip(*(b.column(c).to_pylist() for c in ("record_kind", "shape_key", "fields")), strict=True):
                shape, union = {f["path"]: f["json_type"] for f in fields}, {f["path"]: f["over_all"] for f in fields}
                changes, moved = departures(shape, wanted.get(kind, {}), kind or "", union)
                extra = [(f, union[f]) for f, change in changes if change == "added"]
                for column, v in zip(out, (key, [{"field": f, "change": c} for f, c in changes], sorted(moved.items()), extra), strict=True):
                    column.append(v)
            pairs = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.struct([("field", pa.string()), ("change", pa.string())]))), pa.array(out[2], pairs), pa.array(out[3], pairs)], names=["shape_key", "changes", "moved", "extra"])

    return rows.unionByName(bare).mapInArrow(run, "shape_key string, changes array<struct<field:string,change:string>>, moved map<string,string>, extra map<string,string>")


def file_changes(files: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(file_id, record_kind, written_at, field, change): every departure of every file, copies included."""
    shapes = settled(file_shapes(files))
    of_shape = if_small(settled(shape_changes(shapes, schema_fields).select("shape_key", "changes")), SHAPES_AT_ONCE)
    none = F.struct(F.lit("").alias("field"), F.lit("unreadable").alias("change"))
    kept = ["file_id", "record_kind", "written_at"]
    readable = shapes.where("shape_key is not null").drop("shape").join(of_shape, "shape_key").select(*kept, F.explode("changes").alias("c"))
    rows = readable.unionByName(shapes.where("shape_key is null").select(*kept, none.alias("c")))
    return rows.select(*kept, "c.field", "c.change")


def change_log(files: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(record_kind, field, change, files, first_seen, last_seen, position): the differences in order of their first file."""
    log = file_changes(files, schema_fields).dropDuplicates(["file_id", "field", "change"]).groupBy("record_kind", "field", "change").agg(
        F.count("*").alias("files"), F.min("written_at").alias("first_seen"), F.max("written_at").alias("last_seen"),
    )
    return log.withColumn("position", F.row_number().over(Window.partitionBy("record_kind").orderBy("first_seen", "field", "change")))


_SPARK = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def _cast(value, wanted: str):
    """The value in the wanted type, or None where it can't stand there without loss."""
    try:
        if value is None or wanted in ("string",) and isinstance(value, str):
            return value
        if wanted == "string":
            return (str(value).lower() if isinstance(value, bool) else repr(value)) if isinstance(value, (int, float)) else None
        if wanted == "boolean":
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).strip().lower())
        if isinstance(value, (bool, dict)):
            return None
        number = float(value)
        if wanted == "number":
            return number
        whole = int(value) if isinstance(value, (int, str)) else int(number)
        return whole if whole == number and -(2**63) <= whole < 2**63 else None
    except (ValueError, TypeError, OverflowError):
        return None


def _reach(value, path: str):
    """The value at a path; of a path through an array the list over its elements."""
    if "[]" in path:
        head, _, tail = path.partition("[]")
        at = _reach(value, head)
        return [_reach(x, tail.removeprefix("/")) if tail else x for x in at] if isinstance(at, list) else None
    while isinstance(value, dict):
        if path in value:
            return value[path]
        for k in sorted(value, key=len, reverse=True):
            if path.startswith(f"{k}/"):
                value, path = value[k], path[len(k) + 1 :]
                break
        else:
            return None
    return None


def consistent_table(files: DataFrame, schema_fields: DataFrame, kind: str) -> DataFrame:
    """The readable files of a kind in the wanted schema, one row a file.

    Columns are named as the fields, leaves only; a field in an array becomes an array column. A field
    that moved is taken from where it stands. A one-element array or object around a wanted scalar is
    opened; a value that can't be cast without loss is null and stands, as JSON, in the map ``unfit``. Fields that
    the wanted schema lacks stand in the map ``added``, as JSON in the type that the union schema gives them. Of a file
    that came in several contents one row is kept.
    """
    wanted = _wanted(schema_fields).get(kind, {})
    leaves = [f for f, t in wanted.items() if t in _SPARK]
    fields = [T.StructField("file_id", T.LongType())]
    fields += [T.StructField(f, T.ArrayType(_SPARK[wanted[f]]) if "[]" in f else _SPARK[wanted[f]]) for f in sorted(leaves)]
    text = T.MapType(T.StringType(), T.StringType())
    schema = T.StructType([*fields, T.StructField("unfit", text), T.StructField("added", text)])
    of_kind = _narrow(files).where(F.col("record_kind") == kind)

    def keyed(batches):
        for b in batches:
            payloads = b.column("payload").to_pylist()
            keys = [_told(kind, p)[0] for p in payloads]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(keys, pa.string()), b.column("payload")], names=["file_id", "shape_key", "payload"])

    of_shape = if_small(settled(shape_changes(settled(file_shapes(of_kind)), schema_fields).select("shape_key", "moved", "extra")), SHAPES_AT_ONCE)
    rows = of_kind.mapInArrow(keyed, "file_id bigint, shape_key string, payload string").join(of_shape, "shape_key")

    def scalar(v, want: str, field: str, unfit: dict):
        if isinstance(v, list) and len(v) == 1:
            v = v[0]
        if isinstance(v, dict) and len(v) == 1:
            v = next(iter(v.values()))
        cast = _cast(v, want)
        if cast is None and v is not None:
            unfit[field] = json.dumps(v, default=str)
        return cast

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            out = []
            for i, payload, moved, extra in zip(*(b.column(c).to_pylist() for c in ("file_id", "payload", "moved", "extra")), strict=True):
                value, moved, unfit = parsed(payload), dict(moved), {}
                row = {"file_id": i}
                for f in leaves:
                    v = _reach(value, moved.get(f, f))
                    row[f] = [scalar(x, wanted[f], f, unfit) for x in v] if "[]" in f and v is not None else None if "[]" in f else scalar(v, wanted[f], f, unfit)
                added = [(f, json.dumps(v if t not in _SPARK or (c := _cast(v, t)) is None else c, default=str)) for f, t in extra for v in [_reach(value, f)]]
                out.append(row | {"unfit": list(unfit.items()), "added": added})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema).dropDuplicates(["file_id"])


def found(files: DataFrame, schema_fields: DataFrame) -> DataFrame:
    return file_changes(files, schema_fields).select("file_id", "field", "change").distinct()
