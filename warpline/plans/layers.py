"""Queries on layers, their backward passes, broadcasting arithmetic and images, over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.functions.numeric import r6
from warpline.operators import corpus as C
from warpline.operators import layers as Y
from warpline.operators import tensors as T
from warpline.plans.models import _PIX, V, _cols, _long, _pixels, _round, _rows
from warpline.plans.registry import Registry
from warpline.plans.texts_and_vectors import TOKENS

registry = Registry()
add = registry.add

_MEANS = V + ", c AS (SELECT j, avg(v) AS m FROM long GROUP BY 1), r AS (SELECT i, avg(v) AS m FROM long GROUP BY 1)"
_OPS = {"added": ("a + b", lambda a, b: a + b), "subtracted": ("a - b", lambda a, b: a - b), "taken_from": ("b - a", lambda a, b: b - a), "multiplied": ("a * b", lambda a, b: a * b), "divided": ("a / b", Y.divided), "divides": ("b / a", lambda a, b: Y.divided(b, a))}
for _name, (_sql, _f) in _OPS.items():

    def _by_row(e, f=_f):
        """Every vector and the mean vector."""
        return Y.broadcasted(_long(e), _long(e).groupBy("j").agg(F.avg("v").alias("v")), f, "i")

    def _by_column(e, f=_f):
        """Every vector and its own mean."""
        return Y.broadcasted(_long(e), _long(e).groupBy("i").agg(F.avg("v").alias("v")), f, "j")

    # quotients are cut at 50: by tiny means they would depend on the order of the mean's additions
    for _side, _mean, _key, _build in (("row", "c", "j", _by_row), ("column", "r", "i", _by_column)):
        if "divide" in _name:
            _q = f"SELECT i, j, round(greatest(least({_sql}, 50.0), -50.0), 3) + 0.0 AS v FROM (SELECT long.i, long.j, v AS a, m AS b FROM long JOIN {_mean} USING ({_key}))"
            add(f"tensor_{_side}_{_name}", "embeddings", sql=_MEANS + _q)(lambda e, build=_build: _round(build(e).select("i", "j", F.greatest(F.least("v", F.lit(50.0)), F.lit(-50.0)).alias("v")), 3))
        else:
            _q = f"SELECT i, j, round({_sql}, 4) + 0.0 AS v FROM (SELECT long.i, long.j, v AS a, m AS b FROM long JOIN {_mean} USING ({_key}))"
            add(f"tensor_{_side}_{_name}", "embeddings", sql=_MEANS + _q)(lambda e, build=_build: _round(build(e), 4))

add("tensor_negated", "embeddings", sql=V + "SELECT i, j, round(-v, 6) + 0.0 AS v FROM long")(lambda e: _round(_long(e).select("i", "j", (-F.col("v")).alias("v"))))
add("tensor_compared", "embeddings", sql=V + "SELECT i, j, v <= 0.1 AS v FROM long")(lambda e: _long(e).select("i", "j", (F.col("v") <= 0.1).alias("v")))
add("tensor_masked_assigned", "embeddings", sql=V + "SELECT i, j, round(CASE WHEN v <= 0 THEN 0.0 ELSE v END, 6) + 0.0 AS v FROM long")(lambda e: _round(Y.assigned(_long(e), F.col("v") <= 0, F.lit(0.0))))
add("tensor_index_assigned", "embeddings", sql=V + "SELECT i, j, round(CASE WHEN i % 3 = 0 AND j = 2 THEN 1.0 ELSE v END, 6) + 0.0 AS v FROM long")(lambda e: _round(Y.assigned(_long(e), (F.col("i") % 3 == 0) & (F.col("j") == 2), F.lit(1.0))))
add("tensor_cast", "embeddings", sql=V + "SELECT i, j, trunc(v * 10)::INT AS v FROM long")(lambda e: _long(e).select("i", "j", (F.col("v") * 10).cast("int").alias("v")))
add("tensor_made", "embeddings", sql="SELECT vec_id AS i, list_transform(range(len(embedding)), lambda k: k::DOUBLE) AS arange, list_transform(range(len(embedding)), lambda k: 0.0::DOUBLE) AS zeros FROM embeddings WHERE embedding IS NOT NULL")(
    lambda e: e.where("embedding is not null").select(F.col("vec_id").alias("i"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda k: k.cast("double")).alias("arange"), F.array_repeat(F.lit(0.0), F.size("embedding")).alias("zeros"))
)


@add("initialiser_scales", "runs", sql="""WITH s AS (SELECT DISTINCT try_cast(params['model/hidden_size'] AS DOUBLE) AS n FROM runs WHERE try_cast(params['model/hidden_size'] AS DOUBLE) > 0)
SELECT n AS fan_in, 10.0::DOUBLE AS fan_out, round(sqrt(2 / n), 6) + 0.0 AS he, round(sqrt(1 / n), 6) + 0.0 AS xavier, round(sqrt(2 / (n + 10)), 6) + 0.0 AS glorot, 0.01::DOUBLE AS std FROM s""")
def initialiser_scales(runs):
    """The deviations of initial weights from the layer sizes of the runs to ten outputs."""
    n = runs.select(F.col("params")["model/hidden_size"].try_cast("double").alias("fan_in")).where("fan_in > 0").distinct().withColumn("fan_out", F.lit(10.0))
    return n.select("fan_in", "fan_out", *[r6(Y.scale(k, F.col("fan_in"), F.col("fan_out"))).alias(k) for k in ("he", "xavier", "glorot")], F.lit(0.01).alias("std"))


# the weights of 64 features by 4 outputs, and gradients of the outputs, by a plain rule of their place
_W = ", w AS (SELECT j AS i, k AS j, ((j * 7 + k * 3) % 11 - 5) / 10.0::DOUBLE AS v FROM range(64) a(j), range(4) b(k)), dy AS (SELECT i, k AS j, ((i + 2 * k) % 5 - 2) / 4.0::DOUBLE AS v FROM (SELECT DISTINCT i FROM long), range(4) b(k))"


def _weights(spark):
    return spark.range(256).select(F.expr("id div 4").alias("i"), (F.col("id") % 4).alias("j")).withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5) / 10.0)


def _upstream(e):
    return _rows(e).select(F.col("vec_id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("j")).withColumn("v", ((F.col("i") + 2 * F.col("j")) % 5 - 2) / 4.0)


def _affine_part(k: int):
    return lambda e: _round(Y.affine_gradients(_long(e), _weights(e.sparkSession), _upstream(e))[k], 4)


add("layer_affine_backward_inputs", "embeddings", sql=V + _W + " SELECT dy.i, w.i AS j, round(sum(dy.v * w.v), 4) + 0.0 AS v FROM dy JOIN w ON w.j = dy.j GROUP BY ALL")(_affine_part(0))
add("layer_affine_backward_weights", "embeddings", sql=V + _W + " SELECT long.j AS i, dy.j, round(sum(long.v * dy.v), 4) + 0.0 AS v FROM long JOIN dy USING (i) GROUP BY ALL")(_affine_part(1))
add("layer_affine_backward_bias", "embeddings", sql=V + _W + " SELECT j, round(sum(v), 4) + 0.0 AS v FROM dy GROUP BY 1")(_affine_part(2))
add("layer_affine_tied", "embeddings", sql=V + _W + " SELECT dy.i, w.i AS j, round(sum(dy.v * w.v) + 0.5, 4) + 0.0 AS v FROM dy JOIN w ON w.j = dy.j GROUP BY ALL")(
    # the weights of the layer before, transposed
    lambda e: _round(T.matmul(_upstream(e), T.transposed(_weights(e.sparkSession))).select("i", "j", (F.col("v") + 0.5).alias("v")), 4)
)
_TIMED = V + _W + ", t AS (SELECT i // 8 AS example, i % 8 AS step, j, v FROM long)"
add("layer_time_affine", "embeddings", sql=_TIMED + " SELECT example, step, w.j, round(sum(t.v * w.v), 4) + 0.0 AS v FROM t JOIN w ON w.i = t.j GROUP BY ALL")(
    # time is flattened into rows and unfolded again
    lambda e: _round(T.matmul(_long(e), _weights(e.sparkSession)).select(F.expr("i div 8").alias("example"), (F.col("i") % 8).alias("step"), "j", "v"), 4)
)
_D = ", d AS (SELECT i, j, v, ((i + j) % 5 - 2) / 4.0::DOUBLE AS d FROM long)"


def _cell_upstream(e):
    return _long(e).select("i", "j", (((F.col("i") + F.col("j")) % 5 - 2) / 4.0).alias("v"))


_SLOPE_SQL = {"identity": "1.0", "relu": "(v > 0)::INT", "sigmoid": "(1 / (1 + exp(-v))) * (1 - 1 / (1 + exp(-v)))", "tanh": "1 - tanh(v) * tanh(v)"}
for _name, _sql in _SLOPE_SQL.items():
    add(f"layer_{_name}_backward", "embeddings", sql=V + _D + f" SELECT i, j, round(d * ({_sql}), 5) + 0.0 AS v FROM d")(lambda e, s=Y.SLOPES[_name]: _round(Y.through(_long(e), _cell_upstream(e), s), 5))
add("layer_softmax_backward", "embeddings", sql=V + _D + ", p AS (SELECT i, j, d, exp(v) / sum(exp(v)) OVER (PARTITION BY i) AS p FROM d) SELECT i, j, round(p * (d - sum(p * d) OVER (PARTITION BY i)), 6) + 0.0 AS v FROM p")(lambda e: _round(Y.softmax_gradient(_long(e), _cell_upstream(e))))
add("layer_batch_norm_backward", "embeddings", sql=V + _D + """, s AS (SELECT j, avg(v) AS m, sqrt(var_pop(v) + 1e-7) AS s, avg(d) AS md, avg(d * v) AS mdx FROM d GROUP BY 1)
SELECT i, j, round((d - md - (v - m) / s * (mdx - md * m) / s) / s, 4) + 0.0 AS v FROM d JOIN s USING (j)""")(lambda e: _round(Y.batch_norm_gradient(_long(e), _cell_upstream(e)), 4))
_U = "((i * 7919 + j * 104729) % 10007) / 10007.0::DOUBLE"


def _u():
    return F.pmod(F.col("i") * 7919 + F.col("j") * 104729, F.lit(10007)) / 10007.0


for _name, _sql, _kind in (("train", f"CASE WHEN {_U} > 0.4 THEN v ELSE 0 END", (True, False)), ("eval", "v * 0.6", (False, False)), ("inverted", f"CASE WHEN {_U} > 0.4 THEN v / 0.6 ELSE 0 END", (True, True)), ("inverted_eval", "v", (False, True))):
    add(f"layer_dropout_{_name}", "embeddings", sql=V + f"SELECT i, j, round({_sql}, 5) + 0.0 AS v FROM long")(lambda e, k=_kind: _round(Y.dropped_out(_long(e), 0.4, _u(), *k), 5))

# images
_F = ", fl AS (SELECT f, ky, kx, (f + 1) * (ky - kx) + 0.1 AS w FROM range(2) a(f), range(3) b(ky), range(3) c(kx)), dy AS (SELECT DISTINCT n, f, oy, ox, ((n + f + oy + 2 * ox) % 5 - 2) / 4.0::DOUBLE AS d FROM (SELECT DISTINCT n FROM px), range(2) a(f), range(8) b(oy), range(8) c(ox))"


def _filters(spark):
    at = spark.range(18).select(F.expr("id div 9").alias("f"), F.expr("(id % 9) div 3").cast("int").alias("ky"), F.expr("id % 3").cast("int").alias("kx"))
    return at.withColumn("w", (F.col("f") + 1) * (F.col("ky") - F.col("kx")) + 0.1).withColumn("bias", F.lit(0.0))


def _image_upstream(e, size, filters):
    at = _rows(e).select(F.col("vec_id").alias("n"), *([F.explode(F.sequence(F.lit(0), F.lit(filters - 1))).alias("f")] if filters else []))
    at = at.withColumn("oy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("ox", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return at.withColumn("v", ((F.col("n") + (F.col("f") if filters else 0) + F.col("oy") + 2 * F.col("ox")) % 5 - 2) / 4.0)


def _convolution_part(k: int, digits: int = 4):
    return lambda e: _round(Y.convolution_gradients(_cols(e), _filters(e.sparkSession), _image_upstream(e, 8, 2), 1, 1)[k], digits)


add("image_convolution_backward_pixels", "embeddings", sql=_PIX + _F + " SELECT n, oy + ky - 1 AS y, ox + kx - 1 AS x, round(sum(d * w), 4) + 0.0 AS v FROM dy JOIN fl USING (f) JOIN cols USING (n, oy, ox, ky, kx) GROUP BY ALL")(_convolution_part(0))
add("image_convolution_backward_weights", "embeddings", sql=_PIX + _F + " SELECT f, ky, kx, round(sum(v * d), 3) + 0.0 AS v FROM cols JOIN dy USING (n, oy, ox) GROUP BY ALL")(_convolution_part(1, 3))
add("image_convolution_backward_bias", "embeddings", sql=_PIX + _F + " SELECT f, round(sum(d), 4) + 0.0 AS v FROM dy GROUP BY 1")(_convolution_part(2))


@add("image_max_pool_backward", "embeddings", sql=V + """, px AS (SELECT i AS n, j // 8 AS y, j % 8 AS x, v FROM long), m AS (SELECT n, y, x, row_number() OVER (PARTITION BY n, y // 2, x // 2 ORDER BY v DESC, y, x) AS k FROM px)
SELECT n, y, x, round(((n + y // 2 + 2 * (x // 2)) % 5 - 2) / 4.0::DOUBLE, 4) + 0.0 AS v FROM m WHERE k = 1""")
def image_max_pool_backward(e):
    """The way back through pools of 2 x 2: only the largest pixels get a gradient."""
    return _round(Y.max_pool_gradient(T.max_pooled(T.im2col(_pixels(e), 8, 8, 2, 2)), _image_upstream(e, 4, 0), 2), 4)


add("image_permuted", "embeddings", sql=V + ", p AS (SELECT j, row_number() OVER (ORDER BY md5(j::VARCHAR || '|0'), j) - 1 AS k FROM range(64) r(j)) SELECT i, k AS j, round(v, 6) + 0.0 AS v FROM long JOIN p USING (j)")(lambda e: _round(Y.permuted(_long(e), Y.hashed_permutation(e.sparkSession, 64))))
add("image_tiled", "embeddings", sql=V + ", px AS (SELECT i AS n, j // 8 AS y, j % 8 AS x, v FROM long) SELECT n // 10 * 9 + y AS y, n % 10 * 9 + x AS x, round(v, 6) + 0.0 AS v FROM px")(lambda e: _round(Y.tiled(_pixels(e), 8, 8, 10)))


@add("spiral_points", "conditions", sql="SELECT label, place, round(place / 100.0 * sin(label * 4.0 + place / 100.0 * 4.0), 6) + 0.0 AS x, round(place / 100.0 * cos(label * 4.0 + place / 100.0 * 4.0), 6) + 0.0 AS y FROM range(3) a(label), range(100) b(place)")
def spiral_points(c):
    """Three arms of a hundred points, without noise."""
    return Y.spiral(c.sparkSession, noise=0.0).select("label", "place", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


# attention: the weights of the parts of a vector on each other
_ATT = V + ", h AS (SELECT i AS example, j // 8 AS position, j % 8 AS k, v FROM long), s AS (SELECT a.example, a.position AS step, b.position, sum(a.v * b.v) AS s FROM h a JOIN h b ON a.example = b.example AND a.k = b.k GROUP BY ALL), w AS (SELECT example, step, position, exp(s) / sum(exp(s)) OVER (PARTITION BY example, step) AS weight FROM s)"


def _attention(e):
    h = _long(e).select(F.col("i").alias("example"), F.expr("j div 8").cast("int").alias("position"), (F.col("j") % 8).alias("k"), "v")
    vec = h.groupBy("example", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("h"))
    return h, T.attention(vec.select("example", F.col("position").alias("step"), F.col("h").alias("q")), vec)


def _attention_upstream(h):
    return h.select("example", F.col("position").alias("step"), "k", (((F.col("example") + F.col("position") + F.col("k")) % 3 - 1) / 2.0).alias("v"))


add("attention_context", "embeddings", sql=_ATT + " SELECT example, step, k, round(sum(weight * v), 5) + 0.0 AS v FROM w JOIN h USING (example, position) GROUP BY ALL")(lambda e: _round(Y.attended(_attention(e)[1], _attention(e)[0]), 5))
_AD = ", d AS (SELECT example, position AS step, k, ((example + position + k) % 3 - 1) / 2.0::DOUBLE AS d FROM h)"
add("attention_backward_weights", "embeddings", sql=_ATT + _AD + " SELECT example, step, position, round(sum(v * d), 5) + 0.0 AS v FROM h JOIN d USING (example, k) GROUP BY ALL")(lambda e: _round((lambda h, w: Y.attended_gradients(w, h, _attention_upstream(h))[0])(*_attention(e)), 5))
add("attention_backward_states", "embeddings", sql=_ATT + _AD + " SELECT example, position, k, round(sum(weight * d), 5) + 0.0 AS v FROM w JOIN d USING (example, step) GROUP BY ALL")(lambda e: _round((lambda h, w: Y.attended_gradients(w, h, _attention_upstream(h))[1])(*_attention(e)), 5))


# words and their vectors
@add("corpus_skipgram_encode", "documents", "embeddings", sql=TOKENS + """, e AS (SELECT vec_id AS word_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT doc_id, pos, word_id, round(list_dot_product(v, v), 5) + 0.0 AS norm, len(v) AS size FROM tokens JOIN vocab USING (word) JOIN e USING (word_id)""")
def corpus_skipgram_encode(d, e):
    """The vector of each word as the centre of its place, told by its squared length; words without one have no row."""
    t = C.tokens(d)
    v = e.where("embedding is not null").select(F.col("vec_id").alias("word_id"), A.doubles("embedding").alias("v"))
    words = C.vocabulary(t).select("word", "word_id").join(v, "word_id")
    return t.select("doc_id", "pos", "word").join(words, "word").select("doc_id", "pos", "word_id", r6(A.dot(F.col("v"), F.col("v")), 5).alias("norm"), F.size("v").cast("bigint").alias("size"))


@add("corpus_candidate_scores", "documents", "embeddings", sql=TOKENS + """, e AS (SELECT vec_id AS word_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), known AS (SELECT vocab.word_id, word, v FROM vocab JOIN e USING (word_id)),
p AS (SELECT DISTINCT a.word, b.word AS other FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)
SELECT a.word_id, b.word_id AS candidate, round(list_dot_product(a.v, b.v), 5) + 0.0 AS score FROM p JOIN known a USING (word) JOIN known b ON b.word = p.other""")
def corpus_candidate_scores(d, e):
    """The scores of the pairs of words that follow each other: the product of their vectors."""
    v = e.where("embedding is not null").select(F.col("vec_id").alias("word_id"), A.doubles("embedding").alias("v"))
    known = C.vocabulary(C.tokens(d)).select("word", "word_id").join(v, "word_id")
    words = C.split_collapsed(F.col("text"))
    follow = d.where("text is not null").select(words.alias("w")).where("size(w) > 1").select(F.explode(F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.struct(a.alias("word"), b.alias("other"))))).alias("p")).select("p.*").distinct()
    side = lambda n: known.select(F.col("word").alias(n), F.col("word_id").alias(f"{n}_id"), F.col("v").alias(f"{n}_v"))
    rows = follow.join(side("word"), "word").join(side("other"), "other")
    return rows.select(F.col("word_id"), F.col("other_id").alias("candidate"), r6(A.dot(F.col("word_v"), F.col("other_v")), 5).alias("score"))


@add("corpus_skipgram_pairs", "documents", sql=TOKENS + "SELECT doc_id, pos, words[pos + 1] AS centre, unnest([words[pos - 1], words[pos], words[pos + 2], words[pos + 3]]) AS context FROM (SELECT doc_id, words, unnest(range(2, len(words) - 2))::INT AS pos FROM docs WHERE len(words) > 4)")
def corpus_skipgram_pairs(d):
    """A row of each centre and each word around it: the examples of a skip-gram model, expanded."""
    return C.contexts(d).select("doc_id", "pos", F.col("target").alias("centre"), F.explode("context").alias("context"))


@add("corpus_skipgram_grouped", "documents", sql=TOKENS + "SELECT words[pos + 1] AS centre, count(*) AS places, sum(len([words[pos - 1], words[pos], words[pos + 2], words[pos + 3]]))::BIGINT AS contexts FROM (SELECT doc_id, words, unnest(range(2, len(words) - 2))::INT AS pos FROM docs WHERE len(words) > 4) GROUP BY 1")
def corpus_skipgram_grouped(d):
    """The sizes of the examples grouped by their centre, which share its look-up."""
    return C.contexts(d).groupBy(F.col("target").alias("centre")).agg(F.count("*").alias("places"), F.sum(F.size("context")).alias("contexts"))


@add("loss_running", "updates", sql="""WITH u AS (SELECT run_id, update_no, max(loss) AS loss, max(batch_size) AS units FROM updates WHERE loss IS NOT NULL AND isfinite(loss) AND batch_size IS NOT NULL GROUP BY ALL)
SELECT run_id, update_no, round(sum(loss * units) OVER w / sum(units) OVER w, 6) + 0.0 AS running FROM u WINDOW w AS (PARTITION BY run_id ORDER BY update_no)""")
def loss_running(u):
    """The mean loss of a run so far, weighted by the batches' sizes; one run's updates are ordered in one task."""
    from pyspark.sql import Window

    from warpline.functions.numeric import finite

    rows = u.where(finite("loss") & F.col("batch_size").isNotNull()).groupBy("run_id", "update_no").agg(F.max("loss").alias("loss"), F.max("batch_size").alias("units"))
    w = Window.partitionBy("run_id").orderBy("update_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("run_id", "update_no", r6(F.sum(F.col("loss") * F.col("units")).over(w) / F.sum("units").over(w)).alias("running"))
