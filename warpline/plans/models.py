"""Queries on tensors, losses, optimisers and sampling, over the embeddings and the run store."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.functions.numeric import finite, r6
from warpline.operators import losses as L
from warpline.operators import optimizers as O
from warpline.operators import sampling as S
from warpline.operators import tensors as T
from warpline.plans.registry import Registry
from warpline.session import if_small, settled

registry = Registry()
add = registry.add
#: Words of a vocabulary that is sent along at most; they are short.
WORDS = 1_000_000

V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), long AS (SELECT vec_id AS i, unnest(range(len(e)))::INT AS j, unnest(e) AS v FROM v)"


def _round(long, digits=6):
    return long.withColumn("v", r6(F.col("v"), digits))


def _long(e):
    return T.long_form(e, "vec_id", "embedding")


def _rows(e):
    return e.where("embedding is not null").select("vec_id", "label", A.doubles("embedding").alias("e"))


add("tensor_long", "embeddings", sql=V + "SELECT i, j, round(v, 6) + 0.0 AS v FROM long")(lambda e: _round(_long(e)))
add("tensor_transposed", "embeddings", sql=V + "SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM long")(lambda e: _round(T.transposed(_long(e))))
add("tensor_rows", "embeddings", sql=V + "SELECT vec_id AS i, list_transform(e, lambda x: round(x, 6) + 0.0) AS vec FROM v")(lambda e: T.row_form(_round(_long(e))))
add("tensor_gram", "embeddings", sql=V + "SELECT a.j AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM long a JOIN long b ON a.i = b.i GROUP BY ALL")(lambda e: _round(T.gram(e, "embedding"), 5))


@add("tensor_matmul", "embeddings", sql=V + """, w AS (SELECT label AS i, j, avg(v) AS v FROM long JOIN v ON vec_id = i GROUP BY ALL)
SELECT l.i, w.i AS j, round(sum(l.v * w.v), 5) + 0.0 AS v FROM long l JOIN w ON w.j = l.j GROUP BY ALL""")
def tensor_matmul(e):
    """All vectors times the transposed matrix of the labels' means."""
    means = _long(e).join(e.select(F.col("vec_id").alias("i"), "label"), "i").groupBy(F.col("label").alias("i"), "j").agg(F.avg("v").alias("v"))
    return _round(T.matmul(_long(e), T.transposed(means)), 5)


for _how in ("sum", "mean", "max"):
    _f = {"sum": "sum", "mean": "avg", "max": "max"}[_how]
    add(f"tensor_{_how}_rows", "embeddings", sql=V + f"SELECT i, round({_f}(v), 6) + 0.0 AS v FROM long GROUP BY i")(lambda e, how=_how: _round(T.reduced(_long(e), "j", how)))
    add(f"tensor_{_how}_columns", "embeddings", sql=V + f"SELECT j, round({_f}(v), 5) + 0.0 AS v FROM long GROUP BY j")(lambda e, how=_how: _round(T.reduced(_long(e), "i", how), 5))
add("tensor_argmax", "embeddings", sql=V + "SELECT i, min(j)::INT AS argmax FROM (SELECT *, max(v) OVER (PARTITION BY i) AS m FROM long) WHERE v = m GROUP BY i")(lambda e: T.first_argmax(_long(e)))
add("tensor_reshaped", "embeddings", sql=V + "SELECT (i * 64 + j) // 32 AS i, (i * 64 + j) % 32 AS j, round(v, 6) + 0.0 AS v FROM long")(lambda e: _round(T.reshaped(_long(e), 64, 32)))
add("tensor_standardised", "embeddings", sql=V + "SELECT i, j, round((v - avg(v) OVER (PARTITION BY j)) / sqrt(var_pop(v) OVER (PARTITION BY j) + 1e-7), 5) + 0.0 AS v FROM long")(lambda e: _round(T.standardised(_long(e)), 5))


@add("tensor_elementwise", "embeddings", sql=V + """, n AS (SELECT i - 1 AS i, j, v FROM long)
SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, round(coalesce(a.v, 0) * 2 - coalesce(b.v, 0) / 4, 6) + 0.0 AS v FROM long a FULL JOIN n b ON a.i = b.i AND a.j = b.j""")
def tensor_elementwise(e):
    """Each vector against the next one, cell by cell."""
    return _round(T.elementwise(_long(e), _long(e).withColumn("i", F.col("i") - 1), lambda a, b: a * 2 - b / 4))


@add("tensor_gather", "embeddings", sql=V + "SELECT a.vec_id AS pos, b.vec_id AS row, list_transform(b.e, lambda x: round(x, 6) + 0.0) AS vec FROM v a JOIN v b ON b.vec_id = a.label")
def tensor_gather(e):
    """The row whose number is the label."""
    table = _rows(e).select(F.col("vec_id").alias("row"), F.transform("e", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))
    return T.gathered(e.where("embedding is not null").select(F.col("vec_id").alias("pos"), F.col("label").cast("bigint").alias("row")), table).select("pos", "row", "vec")


@add("tensor_scatter_add", "embeddings", sql=V + "SELECT label AS row, j, round(sum(v), 5) + 0.0 AS v FROM long JOIN v ON vec_id = i GROUP BY ALL")
def tensor_scatter_add(e):
    ids = e.select(F.col("vec_id").alias("pos"), F.col("label").alias("row"))
    return _round(T.scatter_added(ids, _long(e).withColumnRenamed("i", "pos")), 5)


_MAP = "list_transform(e, lambda x: {0})"
for _name, _sql, _fn in (
    ("exp", "exp(x)", F.exp), ("sqrt_abs", "sqrt(abs(x))", lambda x: F.sqrt(F.abs(x))), ("log_abs", "ln(abs(x) + 1e-7)", lambda x: F.ln(F.abs(x) + 1e-7)),
    ("sigmoid", "1.0 / (1.0 + exp(-x))", A.sigmoid), ("tanh", "tanh(x)", F.tanh), ("relu", "greatest(x, 0.0)", lambda x: F.greatest(x, F.lit(0.0))), ("step", "(x > 0)::INT::DOUBLE", lambda x: (x > 0).cast("double")),
):
    add(f"layer_{_name}", "embeddings", sql=V + f"SELECT vec_id, list_transform({_MAP.format(_sql)}, lambda y: round(y, 5) + 0.0) AS e FROM v")(lambda e, fn=_fn: _rows(e).select("vec_id", F.transform("e", lambda x: F.round(fn(x), 5) + F.lit(0.0)).alias("e")))
_SOFT = "list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e)))))"
add("layer_softmax", "embeddings", sql=V + f"SELECT vec_id, list_transform({_SOFT}, lambda y: round(y, 6) + 0.0) AS e FROM v")(lambda e: _rows(e).select("vec_id", F.transform(A.softmax(F.col("e")), lambda x: F.round(x, 6) + F.lit(0.0)).alias("e")))
add("layer_one_hot", "embeddings", sql="SELECT vec_id, list_transform(range(10), lambda k: (k = label)::INT::DOUBLE) AS one_hot FROM embeddings")(lambda e: e.select("vec_id", A.one_hot(F.col("label"), 10).alias("one_hot")))


@add("layer_affine", "embeddings", sql=V + ", w AS (SELECT label, list(m ORDER BY j) AS w FROM (SELECT label, j, avg(v) AS m FROM long JOIN v ON vec_id = i GROUP BY ALL) GROUP BY label) SELECT vec_id, list(round(list_dot_product(e, w) + 0.1 * w.label, 5) + 0.0 ORDER BY w.label) AS scores FROM v, w GROUP BY vec_id")
def layer_affine(e):
    """Scores of every label: the dot product with its mean vector and a bias."""
    return _scores(e).select("vec_id", F.transform("scores", lambda x: F.round(x, 5) + F.lit(0.0)).alias("scores"))


def _scores(e):
    """The weights are as many as the labels, a fixed number of classes, and are sent along as one row."""
    means = _long(e).join(e.select(F.col("vec_id").alias("i"), "label"), "i").groupBy("label", "j").agg(F.avg("v").alias("v"))
    w = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda r: r["v"]).alias("w"))
    packed = w.agg(F.array_sort(F.collect_list(F.struct("label", "w"))).alias("weights"))
    return _rows(e).crossJoin(packed).select("vec_id", "label", F.transform("weights", lambda r: A.dot(F.col("e"), r["w"]) + 0.1 * r["label"]).alias("scores"))


SCORES = V + """, w AS (SELECT label, list(m ORDER BY j) AS w FROM (SELECT label, j, avg(v) AS m FROM long JOIN v ON vec_id = i GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id, any_value(v.label) AS label, list(list_dot_product(e, w) + 0.1 * w.label ORDER BY w.label) AS e FROM v, w GROUP BY vec_id), p AS (SELECT *, """ + _SOFT + " AS p FROM s)"
add("loss_softmax", "embeddings", sql=SCORES + "SELECT round(avg(-ln(p[label + 1] + 1e-7)) FILTER (WHERE label <> 3), 6) + 0.0 AS loss, count(*) FILTER (WHERE label <> 3) AS unit_count FROM p")(lambda e: L.softmax_cross_entropy(_scores(e), "scores", "label", ignore=3))
add("loss_softmax_gradient", "embeddings", sql=SCORES + "SELECT vec_id, list_transform(p, lambda x, i: CASE WHEN label = 3 THEN 0.0 ELSE round((x - (i = label + 1)::INT) / 100, 6) + 0.0 END) AS gradient FROM p")(lambda e: _scores(e).select("vec_id", F.transform(L.softmax_gradient(F.col("scores"), F.col("label"), F.lit(100.0), 3), lambda x: F.round(x, 6) + F.lit(0.0)).alias("gradient")))
add("loss_grouped", "embeddings", sql=SCORES + "SELECT round(sum(-ln(p[label + 1] + 1e-7) - ln(p[(label + 1) % 10 + 1] + 1e-7)) / (2 * count(*)), 6) + 0.0 AS loss, 2 * count(*) AS unit_count FROM p")(lambda e: L.grouped_cross_entropy(_scores(e).withColumn("labels", F.array(F.col("label"), (F.col("label") + 1) % 10)), "scores", "labels"))
_BCE = "greatest({s}, 0.0) - {s} * {y} + ln(1 + exp(-abs({s})))"
add("loss_binary", "embeddings", sql=V + f"SELECT round(avg({_BCE.format(s='(long.v * 10)', y='(label % 2)')}), 6) + 0.0 AS loss, count(*) AS unit_count FROM long JOIN v ON vec_id = i")(
    # every component as a logit of whether the label is odd
    lambda e: L.binary_cross_entropy(_rows(e).select(F.explode("e").alias("s"), (F.col("label") % 2).cast("double").alias("y")).withColumn("s", F.col("s") * 10), "s", "y")
)
add("loss_negative_sampling", "embeddings", sql=V + f", t AS (SELECT {_BCE.format(s='e[1]', y='1.0')} + list_sum(list_transform(e[2:], lambda x: {_BCE.format(s='x', y='0.0')})) AS t, len(e) AS n FROM v) SELECT round(sum(t) / count(*), 6) + 0.0 AS optimised, round(sum(t) / sum(n), 6) + 0.0 AS reported FROM t")(
    # the first component as the right word's score, all the others as those drawn
    lambda e: L.negative_sampling(_rows(e).select(F.get("e", F.lit(0)).alias("pos"), F.slice("e", F.lit(2), F.size("e")).alias("neg")), "pos", "neg")
)
add("loss_accuracy", "embeddings", sql=SCORES + "SELECT count(*) FILTER (WHERE list_position(e, list_max(e)) = label + 1) AS correct, count(*) AS n, round(count(*) FILTER (WHERE list_position(e, list_max(e)) = label + 1) / count(*), 6) + 0.0 AS accuracy FROM s")(lambda e: L.accuracy(_scores(e), "scores", "label"))
add("loss_perplexity", "updates", sql="""SELECT canonical_condition_id, CASE WHEN m > 20 THEN 'inf'::DOUBLE ELSE round(exp(m), 4) + 0.0 END AS perplexity, round(m, 6) + 0.0 AS loss
FROM (SELECT canonical_condition_id, sum(loss * batch_size) / sum(batch_size) AS m FROM updates WHERE isfinite(loss) AND batch_size IS NOT NULL GROUP BY 1)""")(
    lambda u: L.perplexity(u.where(finite("loss") & F.col("batch_size").isNotNull()), "loss", "batch_size", "canonical_condition_id")
)
add("loss_squared", "embeddings", sql=V + "SELECT round(0.5 * sum(pow(long.v - label, 2)), 6) + 0.0 AS half_sum, round(avg(pow(long.v - label, 2)), 6) + 0.0 AS mean FROM long JOIN v ON vec_id = i")(
    # every component against the label
    lambda e: L.squared_error(_rows(e).select(F.explode("e").alias("a"), F.col("label").cast("double").alias("b")), "a", "b")
)


@add("tensor_numerical_gradient", "embeddings", sql=V + "SELECT vec_id, round(e[1] / 10, 5) + 0.0 AS grad_x, round(2 * e[2], 5) + 0.0 AS grad_y FROM v")
def tensor_numerical_gradient(e):
    """Of x²/20 + y² at the first two components."""
    points = _rows(e).select("vec_id", F.get("e", F.lit(0)).alias("x"), F.get("e", F.lit(1)).alias("y"))
    g = T.numerical_gradient(points, lambda c: c[0] * c[0] / 20 + c[1] * c[1], ["x", "y"])
    return g.select("vec_id", r6(F.col("grad_x"), 5).alias("grad_x"), r6(F.col("grad_y"), 5).alias("grad_y"))


# images: each vector of 64 as an 8 x 8 image
_PIX = V + ", px AS (SELECT i AS n, j // 8 AS y, j % 8 AS x, v FROM long), cols AS (SELECT n, oy, ox, ky, kx, v FROM px, range(3) a(ky), range(3) b(kx), range(8) c(oy), range(8) d(ox) WHERE y = oy + ky - 1 AND x = ox + kx - 1)"


def _pixels(e):
    return _long(e).select(F.col("i").alias("n"), F.expr("j div 8").alias("y"), (F.col("j") % 8).alias("x"), "v")


def _cols(e):
    return T.im2col(_pixels(e), 8, 8, 3, 1, 1)


add("image_im2col", "embeddings", sql=_PIX + "SELECT n, oy, ox, ky, kx, round(v, 6) + 0.0 AS v FROM cols")(lambda e: _round(_cols(e)))
add("image_col2im", "embeddings", sql=_PIX + "SELECT n, oy + ky - 1 AS y, ox + kx - 1 AS x, round(sum(v), 5) + 0.0 AS v FROM cols GROUP BY ALL")(lambda e: _round(T.col2im(_cols(e), 1, 1), 5))
add("image_max_pool", "embeddings", sql=V + ", px AS (SELECT i AS n, j // 8 AS y, j % 8 AS x, v FROM long) SELECT n, oy, ox, round(v, 6) + 0.0 AS v, ky, kx FROM (SELECT n, y // 2 AS oy, x // 2 AS ox, y % 2 AS ky, x % 2 AS kx, v, row_number() OVER (PARTITION BY n, y // 2, x // 2 ORDER BY v DESC, y, x) AS k FROM px) WHERE k = 1")(lambda e: _round(T.max_pooled(T.im2col(_pixels(e), 8, 8, 2, 2, 0))))


@add("image_convolution", "embeddings", sql=_PIX + "SELECT n, f, oy, ox, round(sum(v * (f + 1) * (ky - kx)) + 0.5 * max(f), 5) + 0.0 AS v FROM cols, range(2) t(f) GROUP BY ALL")
def image_convolution(e):
    """Two 3 x 3 filters over padded images."""
    spark = e.sparkSession
    filters = spark.createDataFrame([(f, ky, kx, float((f + 1) * (ky - kx)), 0.5 * f) for f in range(2) for ky in range(3) for kx in range(3)], "f bigint, ky int, kx int, w double, bias double")
    return _round(T.convolved(_cols(e), filters), 5)


@add("attention_weights", "embeddings", sql=V + """, q AS (SELECT example, step, list(x ORDER BY k) AS q FROM (SELECT label AS example, i AS step, j % 8 AS k, avg(v) AS x FROM long JOIN v ON vec_id = i GROUP BY ALL) GROUP BY ALL),
h AS (SELECT example, position, list(x ORDER BY k) AS h FROM (SELECT label AS example, j // 8 AS position, j % 8 AS k, avg(v) AS x FROM long JOIN v ON vec_id = i GROUP BY ALL) GROUP BY ALL),
s AS (SELECT example, step, position, list_dot_product(q, h) AS s FROM q JOIN h USING (example))
SELECT example, step, position, round(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 6) + 0.0 AS weight FROM s WINDOW w AS (PARTITION BY example, step)""")
def attention_weights(e):
    """Every vector, as the mean of its eight parts, asks eight states: the parts of its label's mean vector."""
    cells = _long(e).join(e.select(F.col("vec_id").alias("i"), F.col("label").alias("example")), "i").withColumns({"position": F.expr("j div 8"), "k": F.col("j") % 8})
    packed = lambda rows, keys: rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("vec"))
    q = packed(cells.groupBy("example", F.col("i").alias("step"), "k").agg(F.avg("v").alias("x")), ["example", "step"]).withColumnRenamed("vec", "q")
    h = packed(cells.groupBy("example", "position", "k").agg(F.avg("v").alias("x")), ["example", "position"]).withColumnRenamed("vec", "h")
    return T.attention(q, h).withColumn("weight", r6(F.col("weight")))


# optimisers: paths of one rule from the starts given by conditions
def _trajectory(rule):
    def build(conditions):
        starts = conditions.select(F.col("canonical_condition_id").alias("condition"), (-F.col("recording_every") / 7.0).alias("x"), (F.col("eval_every") / 30.0).alias("y"))
        path = O.trajectory(starts, rule, lambda p, axis: p / 10 if axis == "x" else 2 * p, ("x", "y"), 30)
        return path.select("condition", "step", r6(F.col("x"), 5).alias("x"), r6(F.col("y"), 5).alias("y"))

    return build


_PATH_SQL = """WITH RECURSIVE p AS (
  SELECT canonical_condition_id AS condition, 0 AS step, -recording_every / 7.0::DOUBLE AS x, eval_every / 30.0::DOUBLE AS y, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 0.0::DOUBLE AS bx, 0.0::DOUBLE AS by_ FROM conditions
  UNION ALL SELECT condition, step + 1, {x}, {y}, {ax}, {ay}, {bx}, {by} FROM (SELECT *, x / 10 AS gx, 2 * y AS gy FROM p WHERE step < 30))
SELECT condition, step, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y FROM p"""


def _path_sql(new: str, a: str = "0.0", b: str = "0.0") -> str:
    of = lambda t, k: t.replace("$A", f"({a})").replace("$B", f"({b})").replace("@p", k).replace("@g", f"g{k}").replace("@a", f"a{k}").replace("@b", "bx" if k == "x" else "by_")
    return _PATH_SQL.format(x=of(new, "x"), y=of(new, "y"), ax=of(a, "x"), ay=of(a, "y"), bx=of(b, "x"), by=of(b, "y"))


_RULE_SQL = {
    "sgd": _path_sql("@p - 0.95 * @g"),
    "momentum": _path_sql("@p + $A", "0.9 * @a - 0.1 * @g"),
    "nesterov": _path_sql("@p + 0.81 * $A - 1.9 * 0.1 * @g", "0.9 * @a - 0.1 * @g"),
    "adagrad": _path_sql("@p - 1.5 * @g / (sqrt($A) + 1e-7)", "@a + @g * @g"),
    "rmsprop": _path_sql("@p - 0.1 * @g / (sqrt($A) + 1e-7)", "0.99 * @a + 0.01 * @g * @g"),
    "adam": _path_sql("@p - 0.3 * sqrt(1 - pow(0.999, step + 1)) / (1 - pow(0.9, step + 1)) * $A / (sqrt($B) + 1e-7)", "@a + 0.1 * (@g - @a)", "@b + 0.001 * (@g * @g - @b)"),
}
for _rule in O.RULES:
    add(f"optimizer_{_rule}", "conditions", sql=_RULE_SQL[_rule])(_trajectory(_rule))


@add("optimizer_clip", "embeddings", sql=V + ", n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY i)) AS n FROM long) SELECT i, j, round(v * least(1.0, 0.25 / (n + 1e-6)), 6) + 0.0 AS v FROM n")
def optimizer_clip(e):
    return _round(O.clipped(_long(e), "i", "v", 0.25).select("i", "j", "v"))


@add("optimizer_sparse_adam", "embeddings", sql=V + """, g AS (SELECT label AS row, sum(e[1]) AS g FROM v GROUP BY 1), t AS (SELECT vec_id AS row, e[2] AS p, g.g FROM v LEFT JOIN g ON g.row = v.vec_id)
SELECT row, round(CASE WHEN g IS NULL THEN p ELSE p - 0.001 * sqrt(1 - 0.999) / (1 - 0.9) * (0.1 * g) / (sqrt(0.001 * g * g) + 1e-7) END, 6) + 0.0 AS p FROM t""")
def optimizer_sparse_adam(e):
    """One step on a table of all rows with gradients of a few."""
    table = _rows(e).select(F.col("vec_id").alias("row"), F.get("e", F.lit(1)).alias("p"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"))
    g = _rows(e).select(F.col("label").cast("bigint").alias("row"), F.get("e", F.lit(0)).alias("g"))
    return O.sparse_adam_step(table, g, 1).select("row", r6(F.col("p")).alias("p"))


@add("training_classifiers", "embeddings")
def training_classifiers(e):
    """A small network per seed on all vectors, told to find their label."""
    return O.trained_classifiers(_rows(e).select(F.lit("all").alias("condition"), F.col("e").alias("x"), "label"))


@add("sampling_negatives", "documents")
def sampling_negatives(d):
    """Five negatives of every token's word in all documents, from their powered unigram distribution."""
    from warpline.operators import corpus as C

    t = C.tokens(d)
    v = settled(C.vocabulary(t))
    return S.drawn(C.encoded(t, if_small(v.select("word", "word_id"), WORDS)), ["doc_id", "pos"], C.unigram(v.select("word_id", "n")), 5, "word_id")


_MD5_U = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
add("sampling_split", "documents", sql="SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) > count(*) OVER () - floor(count(*) OVER () * 0.1) THEN 'test' ELSE 'train' END AS split FROM documents")(lambda d: S.split(d.select("doc_id"), "doc_id"))
_ROUND = "floor(" + _MD5_U.format("'0|' || vec_id || '|' || draw || '|{0}'") + " * 10)::BIGINT"
add("sampling_rejected", "embeddings", sql="WITH d AS (SELECT vec_id, label, unnest(range(1, 6)) AS draw FROM embeddings) SELECT vec_id, label, draw::INT AS draw, " + "".join(f"CASE WHEN {_ROUND.format(r)} <> label THEN {_ROUND.format(r)} ELSE " for r in range(3)) + "(label + 1) % 10" + " END" * 3 + " AS negative FROM d")(
    lambda e: S.rejected(e.select("vec_id", "label"), ["vec_id"], "label", 10, 5)
)
add("sampling_uniform", "documents", sql="SELECT doc_id, floor(" + _MD5_U.format("'7|' || doc_id") + " * 1000)::BIGINT AS word FROM documents")(lambda d: d.select("doc_id", F.floor(S.digest_uniform("doc_id", seed=7) * 1000).alias("word")))
add("sampling_without_replacement", "embeddings", sql="SELECT vec_id FROM (SELECT vec_id, -ln(" + _MD5_U.format("'0|' || vec_id") + " + 1e-300) / (label + 1) AS race FROM embeddings WHERE label IS NOT NULL) ORDER BY race, vec_id LIMIT 50")(
    lambda e: S.without_replacement(e.where("label is not null").select("vec_id", (F.col("label") + 1.0).alias("w")), "vec_id", "w", 50).select("vec_id")
)


@add("sampling_batches", "evaluations", sql="SELECT canonical_condition_id, batch, count(*) AS rows FROM (SELECT canonical_condition_id, (row_number() OVER (PARTITION BY canonical_condition_id) - 1) // 32 AS batch, count(*) OVER (PARTITION BY canonical_condition_id) // 32 AS full_ FROM (SELECT DISTINCT canonical_condition_id, run_id, axis, axis_step, metric, split FROM evaluations)) WHERE batch < full_ GROUP BY ALL")
def sampling_batches(e):
    """The sizes of the complete batches of 32 of each condition's shuffled evaluations."""
    from pyspark.sql import Window

    rows = e.select("canonical_condition_id", F.concat_ws("|", "run_id", "axis", "axis_step", "metric", "split").alias("k")).distinct()
    placed = S.shuffled(rows, "canonical_condition_id", "k").withColumn("n", F.count("*").over(Window.partitionBy("canonical_condition_id")))
    return S.batches(placed, 32).groupBy("canonical_condition_id", "batch").agg(F.count("*").alias("rows"))
