"""Column functions on scores, vectors and polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two vectors in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def with_negatives(positive: Column, negative: Column, threshold: float = 0.5, penalty: float = 0.2) -> Column:
    """Score of a node with negative examples: reduced by ``penalty`` (not below -1) if those are close."""
    return F.when(negative > threshold, F.greatest(F.lit(-1.0), positive - penalty)).otherwise(positive)


def noisy_or(values: Column, scale: float = 1.0) -> Column:
    """``1 - prod(1 - (v - 0.01))``, scaled; 0 for an empty list. Zeros pull it slightly below 0, as in the original."""
    return (F.lit(1.0) - F.aggregate(values, F.lit(1.0), lambda p, v: p * (1 - (v - 0.01)))) * scale


def adjective_delta(intercept: Column, mu: Column, sigma: Column, mean: Column, stdev: Column) -> Column:
    """How far a gradable adjective moves a quantity; null unless all five are known."""
    return F.exp(intercept + mu * mean + sigma * stdev) * stdev


def example_similarity(text: Column, example: Column) -> Column:
    """1 for equal texts, 0 for texts with nothing in common, case aside."""
    a, b = F.lower(text), F.lower(example)
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def is_increase(increases: Column, decreases: Column) -> Column:
    """A concept goes up unless more of its attachments say down: ties count as up."""
    return increases >= decreases


def relation_polarity(cause_up: Column, effect_up: Column) -> Column:
    return F.when(cause_up == effect_up, "PROMOTE").otherwise("INHIBIT")


def combined(vector: Column, example: Column, weight: float = 0.75) -> Column:
    return weight * vector + (1 - weight) * example
