"""Row-wise vector expressions over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once; written into a lambda directly it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    """Mean of an array; NULL when it is empty."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def std_population(values: Column) -> Column:
    """Population standard deviation in two passes over the array; NULL when it is empty."""

    def spread(centre: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))

    return F.when(F.size(values) > 0, F.sqrt(let(mean(values), spread) / F.size(values)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def logsumexp(logits: Column, temperature: float = 1.0) -> Column:
    def shifted(top: Column) -> Column:
        powers = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / temperature))
        return top / temperature + F.log(powers)

    return let(F.array_max(logits), shifted)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(
        logsumexp(logits, temperature), lambda norm: F.transform(logits, lambda x: x / temperature - norm)
    )


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def likelihood(sequence_score: Column, token_logprobs: Column) -> Column:
    """The supplied beam score, else the sum of the token transition scores."""
    return F.coalesce(sequence_score, total(token_logprobs))
