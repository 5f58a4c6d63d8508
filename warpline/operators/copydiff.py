"""Differences between two copies of one dataset, found through hierarchical checksums.

Every item of a key (the run itself, a param, a metric reading) is one digest; a key lies in the range that the
leading bits of its 64-bit hash name. A range's checksum is order-free and additive: the count, an xor and two sums of
the digests of its items, as delivered. One aggregation with map-side combine gives the checksums of both sides for
``2**FAN_BITS`` ranges, whatever the number of rows; ranges that agree are done with. Those that differ are split
into ``2**FAN_BITS`` narrower ones, for which only rows under a differing range are read on, and so on until
the differing ranges hold ``RANGE_ROWS`` rows at the mean. These are split once more, to single keys (``DEEPEST`` bits),
now with each digest counted once. Only rows under ranges that differ still reach the leaf comparison, in
which values of one item are compared field by field, with the tolerance. Equal checksums mean equal items; repeated
rows make a wide range differ, values that agree only within the tolerance a narrow one, which costs a comparison
and no result.

Defined results: rows repeated exactly count once; of several copies of a key the latest counts (on a tie the larger
by its values); null and NaN are one value; null keys are left out; an item with several values on a side agrees if
every value of either side has an equal one on the other; empty sides give every key of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.keys import bare_id
from warpline.session import if_small, settled

FAN_BITS, DEEPEST, RANGE_ROWS, TOLERANCE = 10, 40, 4096, 1e-6
_ITEM = ["key", "kind", "name", "step", "logged_ms"]
_OUT = ["original_run_id", "item_kind", "item_name", "step", "logged_ms", "difference"]


def _canonical(value: Column) -> Column:
    """-0.0 and 0.0 are one value, null and NaN another."""
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double")).otherwise(value + F.lit(0.0))


def _row_hash(name: Column, step: Column, ms: Column, value: Column) -> Column:
    return F.xxhash64(name, step, ms, _canonical(value))


def range_of(key: Column, bits: int) -> Column:
    """The number of the range of a key among ``2**bits``."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def param_text(value: Column) -> Column:
    """The same text for values that are equal: trimmed, numbers as doubles, true and false in lower case."""
    bare = F.trim(value)
    n = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    return F.when(n.isNotNull(), F.concat(F.lit("n:"), (n + F.lit(0.0)).cast("string"))).when(F.lower(bare).isin("true", "false"), F.concat(F.lit("b:"), F.lower(bare))).otherwise(F.concat(F.lit("s:"), F.coalesce(bare, F.lit(""))))


# ---- digests: n items, the xor of their hashes, the sums of both halves of these ----


def _half(h: Column) -> tuple[Column, Column]:
    return F.shiftright(h, 32).cast("bigint"), h.bitwiseAND(F.lit(0xFFFFFFFF))


def _of_array(hashes: Column) -> list[Column]:
    add = lambda part: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + _half(h)[part])
    return [F.size(hashes).cast("bigint").alias("n"), F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(h)).alias("x"), add(0).alias("hi"), add(1).alias("lo")]


def _of_key(params: Column) -> Column:
    """The hashes of the run itself and of its params."""
    hashes = F.transform(F.map_entries(params), lambda e: F.xxhash64(e["key"], param_text(e["value"])))
    return F.concat(F.array(F.lit(1).cast("bigint")), F.coalesce(hashes, F.array().cast("array<bigint>")))


def source_side(runs: DataFrame) -> DataFrame:
    """(key, params) of the transferred runs, the latest delivery of each."""
    moved = runs.where(F.col("tags")["transfer.batch"].isNotNull() & F.col("run_id").isNotNull())
    rows = moved.select(bare_id("run_id").alias("key"), F.struct("received_at", F.to_json("params").alias("params")).alias("r"))
    return rows.groupBy("key").agg(F.max("r").alias("r")).select("key", F.from_json("r.params", "map<string,string>").alias("params"))


def target_side(restored: DataFrame) -> DataFrame:
    """(key, which, params, n, x, hi, lo) of the latest restore of each run: small rows, the readings stay where they are.

    ``which`` tells the row of ``restored`` (see ``_which``).
    """
    readings = F.transform("metrics", lambda m: _row_hash(m["metric_key"], m["step"], m["logged_ms"], m["value"]))
    every = F.concat(_of_key(F.col("params")), F.coalesce(F.array_distinct(readings), F.array().cast("array<bigint>")))
    rows = restored.where(F.col("original_run_id").isNotNull()).select(bare_id("original_run_id").alias("key"), _which().alias("which"), F.to_json("params").alias("params"), every.alias("hashes"))
    rows = rows.select("key", F.struct("which", "params", *_of_array(F.col("hashes"))).alias("r"))
    latest = rows.groupBy("key").agg(F.max("r").alias("r"))
    return latest.select("key", "r.which", F.from_json("r.params", "map<string,string>").alias("params"), *[f"r.{c}" for c in ("n", "x", "hi", "lo")])


def _which() -> Column:
    """A restore among those of its run: the later one is larger."""
    return F.struct("restored_at", F.coalesce("run_id", F.lit("")).alias("run_id"), F.xxhash64(F.to_json("params"), "metrics").alias("content"))


# ---- from the widest ranges down ----


def source_readings(metrics: DataFrame, source: DataFrame) -> DataFrame:
    """The readings of the keys of the source, filtered where they are scanned: key, metric_key, step, logged_ms, value."""
    keys = if_small(source.select("key"))
    return metrics.select(bare_id("run_id").alias("key"), "metric_key", "step", "logged_ms", "value").join(keys, "key", "left_semi")


def under(rows: DataFrame, ranges: DataFrame | None, bits: int) -> DataFrame:
    """The rows (key, ...) under the given ranges; all rows for none."""
    if ranges is None:
        return rows
    return rows.withColumn("range", range_of(F.col("key"), bits)).join(if_small(ranges.select("range")), "range", "left_semi").drop("range")


def _differing(source: DataFrame, readings: DataFrame, target: DataFrame, bits: int, once: bool) -> DataFrame:
    """(range, rows) of the ranges whose checksums differ. ``once``: readings repeated exactly count once, as they do in the target."""
    digests = ["n", "x", "hi", "lo"]
    within = range_of(F.col("key"), bits).alias("range")
    single = readings.select(within, _row_hash(F.col("metric_key"), F.col("step"), F.col("logged_ms"), F.col("value")).alias("x"))
    single = single.distinct() if once else single
    single = single.select("range", F.lit(1).cast("bigint").alias("n"), "x", _half(F.col("x"))[0].alias("hi"), _half(F.col("x"))[1].alias("lo"))
    ours = source.select(within, *_of_array(_of_key(F.col("params"))))
    theirs = target.select(within, F.col("n").alias("rows"), *[(F.col(c) if c == "x" else -F.col(c)).alias(c) for c in digests])
    rows = ours.unionByName(single).withColumn("rows", F.col("n")).unionByName(theirs)
    sums = rows.groupBy("range").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.sum("rows").alias("rows"))
    return sums.where((F.col("n") != 0) | (F.col("x") != 0) | (F.col("hi") != 0) | (F.col("lo") != 0)).select("range", "rows")


def differing_ranges(source: DataFrame, metrics: DataFrame, target: DataFrame) -> tuple[DataFrame, int]:
    """The narrowest ranges that differ, and the number of bits that name them.

    Of each level only the number of differing ranges and of the rows under them come to the driver.
    """
    live, bits = None, 0
    while True:
        parts = [under(df, live, bits) for df in (source, target)]
        last = live is not None and (rows <= RANGE_ROWS * ranges or bits + FAN_BITS >= DEEPEST)  # noqa: F821
        bits = DEEPEST if last else bits + FAN_BITS
        live = settled(_differing(parts[0], source_readings(metrics, parts[0]), parts[1], bits, once=last))
        if last:
            return live, bits
        ranges, rows = live.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if not ranges:
            return live, bits


# ---- leaves ----


def _items(side: DataFrame, readings: DataFrame, which: int) -> DataFrame:
    """(items, text, v, side): one row per value."""
    none, text = F.lit(-1).cast("bigint"), F.lit(None).cast("string")
    no = F.lit(None).cast("double")
    runs = side.select("key", F.lit("run").alias("kind"), F.lit("").alias("name"), none.alias("step"), none.alias("logged_ms"), text.alias("text"), no.alias("v"))
    params = side.select("key", F.explode("params").alias("name", "p")).select("key", F.lit("param").alias("kind"), "name", none.alias("step"), none.alias("logged_ms"), param_text(F.col("p")).alias("text"), no.alias("v"))
    values = readings.select("key", F.lit("metric").alias("kind"), F.col("metric_key").alias("name"), "step", "logged_ms", text.alias("text"), _canonical(F.col("value")).alias("v"))
    return runs.unionByName(params).unionByName(values).withColumn("side", F.lit(which))


def _apart(a: Column, b: Column) -> Column:
    """Whether two values differ by more than the tolerance; nulls are one value."""
    endless = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    far = (a != b) & (endless | ~(F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.abs(b))))
    return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(far)


def _lone(values: DataFrame) -> DataFrame:
    """The items with several values of which one has no equal on the other side: the nearest values of that are looked at.

    ``values``: items, text, v, sides (1, 2 or 3 for both).
    """
    w = Window.partitionBy(*_ITEM).orderBy("v", "text")
    here = lambda bit: F.col("sides").bitwiseAND(F.lit(bit)) > 0
    held = F.struct("v", "text")
    near = {f"{d}{bit}": F.last(F.when(here(bit), held), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0)) for bit in (1, 2) for d, o in (("b", w), ("a", Window.partitionBy(*_ITEM).orderBy(F.desc("v"), F.desc("text"))))}
    other = lambda d: F.when(F.col("sides") == 1, F.col(f"{d}2")).otherwise(F.col(f"{d}1"))
    unlike = lambda o: o.isNull() | (F.col("kind") == "param") | _apart(F.col("v"), o["v"])
    return values.withColumns(near).where((F.col("sides") != 3) & unlike(other("a")) & unlike(other("b"))).select(*_ITEM).distinct()


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(items, difference) of two sets of items (see ``_items``).

    Copies and equal values meet in the first aggregation, before rows of one item do, so a hot item is none.
    """
    values = ours.unionByName(theirs).groupBy(*_ITEM, "text", "v").agg(F.bit_or("side").alias("sides"))
    of = lambda bit, f: f(F.when(F.col("sides").bitwiseAND(F.lit(bit)) > 0, F.struct("v", "text")))
    alone = F.count(F.when(F.col("sides") != 3, 1))
    sets = values.groupBy(*_ITEM).agg(F.bit_or("sides").alias("sides"), alone.alias("alone"), *[of(bit, f).alias(f"{n}{bit}") for bit in (1, 2) for n, f in (("least", F.min), ("most", F.max))])
    verdict = F.when(F.col("sides") == 1, "missing_in_target").when(F.col("sides") == 2, "missing_in_source").otherwise("differs")
    single = (F.col("least1") == F.col("most1")) & (F.col("least2") == F.col("most2"))
    unlike = (F.col("kind") != "metric") | _apart(F.col("least1.v"), F.col("least2.v"))
    sure = sets.where((F.col("sides") != 3) | ((F.col("alone") > 0) & single & unlike)).select(*_ITEM, verdict.alias("difference"))
    several = sets.where((F.col("sides") == 3) & (F.col("alone") > 0) & ~single).select(*_ITEM)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in _ITEM]
    lone = _lone(values.alias("l").join(several.alias("r"), same, "left_semi"))
    return sure.unionByName(lone.withColumn("difference", F.lit("differs")))


def differences(runs: DataFrame, metrics: DataFrame, restored: DataFrame) -> DataFrame:
    """(original_run_id, item_kind, item_name, step, logged_ms, difference) of the transferred runs against the restored."""
    source, target = settled(source_side(runs)), settled(target_side(restored))
    ranges, bits = differing_ranges(source, metrics, target)
    source, target = under(source, ranges, bits), under(target, ranges, bits)
    rows = restored.select(bare_id("original_run_id").alias("key"), _which().alias("which"), "metrics")
    theirs = under(rows, ranges, bits).join(target.select("key", "which"), ["key", "which"], "left_semi").select("key", F.inline("metrics"))
    found = compared(_items(source, source_readings(metrics, source), 1), _items(target, theirs, 2))
    # nothing but its absence is listed for a run that one side lacks
    there = source.select("key").join(target.select("key", F.lit(True).alias("there")), "key")
    found = found.join(there, "key", "left").where("kind = 'run' or there")
    return found.select(*[F.col(c).alias(n) for c, n in zip([*_ITEM, "difference"], _OUT, strict=True)])
