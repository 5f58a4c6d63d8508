"""Losses and accuracies of rows of scores, as one projection and one aggregation.

Scores are array<double> columns. Rows with the ignored label count for nothing; without any counted row the
loss is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.functions.numeric import r6

EPS = 1e-7
#: Mean losses above this have an infinite perplexity.
ENDLESS = 20.0


def softmax_terms(scores: Column, label: Column) -> Column:
    return -F.ln(F.get(A.softmax(scores), label) + EPS)


def softmax_cross_entropy(rows: DataFrame, scores: str, label: str, ignore: int = -1) -> DataFrame:
    """(loss, unit_count): the mean over rows whose label isn't ignored."""
    kept = F.col(label) != ignore
    return rows.agg(r6(F.avg(F.when(kept, softmax_terms(F.col(scores), F.col(label))))).alias("loss"), F.count_if(kept).alias("unit_count"))


def softmax_gradient(scores: Column, label: Column, units: Column, ignore: int = -1) -> Column:
    """(softmax - one-hot) / units; zeros of ignored rows."""
    p = A.softmax(scores)
    return F.transform(p, lambda x, i: F.when(label == ignore, F.lit(0.0)).otherwise((x - (i == label).cast("double")) / units))


def binary_terms(s: Column, y: Column) -> Column:
    """Cross entropy of logits in a form that doesn't overflow."""
    return F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))


def binary_cross_entropy(rows: DataFrame, logit: str, target: str) -> DataFrame:
    return rows.agg(r6(F.avg(binary_terms(F.col(logit), F.col(target)))).alias("loss"), F.count("*").alias("unit_count"))


def grouped_cross_entropy(rows: DataFrame, scores: str, labels: str) -> DataFrame:
    """(loss, unit_count): several labels share a row of scores."""
    each = rows.select(A.softmax(F.col(scores)).alias("p"), F.col(labels).alias("labels"))
    terms = F.transform("labels", lambda k: -F.ln(F.get(F.col("p"), k) + EPS))
    return each.select(A.total(terms).alias("t"), F.size("labels").alias("n")).agg(r6(F.sum("t") / F.sum("n")).alias("loss"), F.sum("n").alias("unit_count"))


def negative_sampling(rows: DataFrame, positive: str, negatives: str) -> DataFrame:
    """(optimised, reported): the score of the right word against those of the drawn ones, per example and per candidate."""
    n = F.col(negatives)
    total = binary_terms(F.col(positive), F.lit(1.0)) + A.total(F.transform(n, lambda s: binary_terms(s, F.lit(0.0))))
    return rows.agg(r6(F.sum(total) / F.count("*")).alias("optimised"), r6(F.sum(total) / F.sum(F.size(n) + 1)).alias("reported"))


def perplexity(rows: DataFrame, loss: str, units: str, *keys: str) -> DataFrame:
    """(keys, perplexity, loss): of the mean loss by units; infinite where that is above ``ENDLESS``."""
    mean = F.sum(F.col(loss) * F.col(units)) / F.sum(units)
    m = rows.groupBy(*keys).agg(mean.alias("m"))
    return m.select(*keys, F.when(F.col("m") > ENDLESS, float("inf")).otherwise(r6(F.exp("m"), 4)).alias("perplexity"), r6(F.col("m")).alias("loss"))


def accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """(correct, n, accuracy) by the first largest score."""
    right = F.count_if(A.argmax(F.col(scores)) == F.col(label))
    return rows.agg(right.alias("correct"), F.count("*").alias("n"), r6(right / F.count("*")).alias("accuracy"))


def squared_error(rows: DataFrame, guess: str, target: str) -> DataFrame:
    gap = F.col(guess) - F.col(target)
    return rows.agg(r6(0.5 * F.sum(gap * gap)).alias("half_sum"), r6(F.avg(gap * gap)).alias("mean"))
