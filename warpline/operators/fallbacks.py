"""Values and curves from the first source that has them, and the plans and look-ups around runs.

Nulls and values that aren't finite are no values; of several values at one place the largest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.numeric import finite

#: Kinds of kernels by what their names hold, the first that fits; fixed values.
KERNELS = (("gemm", ("gemm", "matmul", "grad_norm")), ("elementwise", ("elementwise", "add", "mul", "lr")), ("reduction", ("reduce", "softmax", "sum", "loss")))
#: The streams that are seeded from one master, in the order of their offsets of 10,000 each; fixed values.
STREAMS = ("initial", "shuffle", "dropout", "sampling", "evaluation")


def first_source(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The rows of the first of the sources (of the same columns) that has any for the keys, with ``origin``, its number from 1.

    An aggregation tells the first source of each key; the rows are not ordered.
    """
    rows = None
    for k, s in enumerate(sources, 1):
        one = s.withColumn("origin", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy(*keys).agg(F.min("origin").alias("origin"))
    return rows.join(first, [*keys, "origin"], "left_semi").select(*rows.columns)


def points(rows: DataFrame, keys: Sequence[str], step: Column, value: Column) -> DataFrame:
    """(keys, step, value) of the finite values, one of each step."""
    return rows.select(*keys, step.cast("bigint").alias("step"), value.alias("value")).where(finite("value") & F.col("step").isNotNull()).groupBy(*keys, "step").agg(F.max("value").alias("value"))


def loss_curves(metrics: DataFrame, evaluations: DataFrame, updates: DataFrame) -> DataFrame:
    """(run_id, step, value, origin): the logged training loss, else the evaluated one, else the updates', with steps from 0."""
    step = F.col("step") - 1
    logged = points(metrics.where("metric_key = 'update/train/loss'"), ["run_id"], step, F.col("value"))
    asked = points(evaluations.where("axis = 'update' AND split = 'train' AND metric = 'loss'"), ["run_id"], F.col("axis_step") - 1, F.col("value"))
    raw = points(updates, ["run_id"], F.col("update_no") - 1, F.col("loss"))
    return first_source([logged, asked, raw], ["run_id"])


def accuracy_curves(evaluations: DataFrame) -> DataFrame:
    """(condition, run_id, step, value, origin): of the validation by epoch, of the training by update, of the final test, the first that any run of the condition has."""
    rows = evaluations.where("metric = 'accuracy'").withColumnRenamed("canonical_condition_id", "condition")
    of = lambda axis, split, step: points(rows.where((F.col("axis") == axis) & (F.col("split") == split)), ["condition", "run_id"], step, F.col("value"))
    return first_source([of("epoch", "valid", F.col("axis_step")), of("update", "train", F.col("axis_step")), of("terminal", "test", F.lit(0))], ["condition"])


def axis_of(rows: DataFrame) -> DataFrame:
    """rows with ``x``: accuracies by epoch, update, or place; others by update, epoch, or place; 0 is a place like any other."""
    place = F.col("axis_step")
    return rows.withColumn("x", F.when(F.col("metric") == "accuracy", F.coalesce("epoch", "update_no", place)).otherwise(F.coalesce("update_no", "epoch", place)).cast("bigint"))


def last_recorded(metrics: DataFrame) -> DataFrame:
    """(run_id, metric_key, value): the value logged last, whatever its step; the largest of one moment."""
    return metrics.where(finite("value")).groupBy("run_id", "metric_key").agg(F.max(F.struct("logged_ms", "received_at", "value"))["value"].alias("value"))


def kernel_kind(name: Column) -> Column:
    kind = None
    for k, parts in KERNELS:
        fits = None
        for p in parts:
            fits = F.lower(name).contains(p) if fits is None else fits | F.lower(name).contains(p)
        kind = F.when(fits, k) if kind is None else kind.when(fits, k)
    return kind.otherwise("other")


def launch_gaps(rows: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """(kind, gaps, total): the times between a row and the one before it in its key, by the row's kind.

    A key's rows are ordered in one task.
    """
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, kind))
    gaps = rows.select(kind, (F.col(at) - before).alias("gap")).where("gap is not null")
    return gaps.groupBy(kind).agg(F.count("*").alias("gaps"), F.sum("gap").alias("total"))


def look_up(wanted: DataFrame, stored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, state, <name>): ``absent``, ``found`` with its name, or ``conflict`` if several are stored."""
    there = stored.groupBy(*keys).agg(F.count_distinct(name).alias("n"), F.min(name).alias(name))
    rows = wanted.select(*keys).distinct().join(there, list(keys), "left")
    state = F.when(F.col("n").isNull(), "absent").when(F.col("n") == 1, "found").otherwise("conflict")
    return rows.select(*keys, state.alias("state"), F.when(F.col("n") == 1, F.col(name)).alias(name))


def checked(rows: DataFrame) -> DataFrame:
    """The rows of ``look_up`` without ``state``; a conflict raises."""
    if (n := rows.where("state = 'conflict'").count()) > 0:
        raise ValueError(f"{n} keys are stored more than once")
    return rows.drop("state")


def parameter_counts(manifest: DataFrame, model: str, name: str, size: Column, itemsize: int = 4, states: int = 2) -> DataFrame:
    """(model, parameters, elements, duplicates, parameter_bytes, gradient_bytes, state_bytes) of a manifest (model, name, size).

    A name that stands twice is counted once and told in ``duplicates``; ``states`` are the arrays that the optimiser keeps.
    """
    once = manifest.groupBy(model, name).agg(F.max(size).cast("bigint").alias("size"), F.count("*").alias("n"))
    elements = F.sum("size")
    return once.groupBy(model).agg(F.count("*").alias("parameters"), elements.alias("elements"), F.sum(F.col("n") - 1).alias("duplicates"), (elements * itemsize).alias("parameter_bytes"), (elements * itemsize).alias("gradient_bytes"), (elements * itemsize * states).alias("state_bytes"))


def one_value(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, value, distinct): the value of a group, null where its rows disagree."""
    return rows.groupBy(*keys).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias("value"), F.count_distinct(value).alias("distinct"))


def common_cells(rows: DataFrame, group: Sequence[str], cell: Sequence[str], member: str) -> DataFrame:
    """(group, cell) of the cells that all members of the group have."""
    have = rows.groupBy(*group, *cell).agg(F.count_distinct(member).alias("n"))
    return have.join(rows.groupBy(*group).agg(F.count_distinct(member).alias("n")), [*group, "n"], "left_semi").select(*group, *cell)


def file_roles(checkpoints: DataFrame) -> DataFrame:
    """(run_id, role, path, state): the latest checkpoint, for which the final one stands in, and the best and final ones.

    ``state``: ``ok``, ``conflict`` if the chosen path is recorded with several digests, ``missing`` for a role without a file.
    """
    of_kind = checkpoints.groupBy("run_id", "kind").agg(F.max(F.struct("update_no", "path"))["path"].alias("path"))
    wide = of_kind.groupBy("run_id").pivot("kind", ["latest", "best", "final"]).agg(F.max("path"))
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), p.alias("path")) for r, p in (("latest", F.coalesce("latest", "final")), ("best", F.col("best")), ("final", F.col("final")))]))
    rows = wide.select("run_id", roles.alias("r")).select("run_id", "r.role", "r.path")
    digests = checkpoints.where("sha256 is not null").groupBy("run_id", "path").agg(F.count_distinct(F.regexp_replace(F.lower("sha256"), r"[\s\-]+|sha256[:=]", "")).alias("n"))
    state = F.when(F.col("path").isNull(), "missing").when(F.col("n") > 1, "conflict").otherwise("ok")
    return rows.join(digests, ["run_id", "path"], "left").select("run_id", "role", "path", state.alias("state"))


def canonical_json(entries: Column) -> Column:
    """A map of strings as JSON with sorted keys and without blanks; null stays null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def uri_key(uri: Column) -> Column:
    """The digest of an address without its credentials."""
    return F.sha2(F.regexp_replace(uri, "://[^/@]*@", "://"), 256)


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(place, line): a table in Markdown, one line a row; nulls are empty cells. The result is a report, so it is ordered as a whole."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "place int, line string")
    return head.unionByName(body)
