"""Scores, probabilities and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def review_priority(confidence: Column, entropy: Column, variance: Column, ood: Column) -> Column:
    return F.round(0.35 * (1 - confidence) + 0.2 * entropy + 0.25 * F.least(F.lit(1.0), 50 * variance) + 0.2 * ood, 4)


def logprob_confidence(log_prob: Column) -> Column:
    """exp of a log-probability within 0 and 1; null is 1."""
    return F.when(log_prob.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(log_prob))))


def combined(asr: Column, model: Column) -> Column:
    """The model's confidence times the recogniser's within 0 and 1, 4 places; without the latter the model's."""
    return F.when(asr.isNull(), model).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), asr)) * model, 4))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    shifted = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def entropy(p: Column) -> Column:
    """Shannon entropy of probabilities as a share of the largest possible."""
    bits = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return bits / F.log(F.size(p).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2(v: Column) -> Column:
    """A vector of length 1 of the same direction; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def ood_score(distance: Column, quantiles: list[float] | None, dim: Column | int = 1) -> Column:
    """0 to 1 by the distance's place among the quantiles 50, 90, 95, 99 and 99.5 (0, .25, .5, .85, 1, linear between);
    without quantiles that rise, the distance over twice the root of the dimension."""
    if not quantiles or any(b <= a for a, b in zip(quantiles, quantiles[1:])):
        width = dim if isinstance(dim, Column) else F.lit(dim)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance / (2 * F.sqrt(width.cast("double")))))
    marks = [0.0, 0.25, 0.5, 0.85, 1.0]
    out = F.when(distance <= quantiles[0], 0.0)
    for (a, b), (x, y) in zip(zip(quantiles, quantiles[1:], strict=False), zip(marks, marks[1:], strict=False), strict=True):
        out = out.when(distance <= b, x + (y - x) * (distance - a) / (b - a if b > a else 1.0))
    return out.otherwise(1.0)
