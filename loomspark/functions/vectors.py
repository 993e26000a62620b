"""Vector kernels on ``ARRAY<DOUBLE>``, as higher-order functions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not for each element of an array that ``body`` goes over."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def argmax(x: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column, least: float = 1e-6) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def unit(x: Column, least: float = 1e-6) -> Column:
    return let(F.greatest(norm(x), F.lit(least)), lambda n: F.transform(x, lambda v: v / n))


def log_softmax(x: Column, temperature: float = 1.0) -> Column:
    def less_total(top: Column) -> Column:
        shifted = F.transform(x, lambda v: (v - top) / temperature)
        return let(F.log(_sum(F.transform(shifted, F.exp))), lambda z: F.transform(shifted, lambda v: v - z))

    return let(F.array_max(x), less_total)


def softmax(x: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(x, temperature), lambda v: F.exp(v))


def nll(logits: Column, index: Column) -> Column:
    return -F.element_at(log_softmax(logits), index + 1)


def soft_cross_entropy(draft: Column, target: Column, temperature: float = 1.0) -> Column:
    return -_sum(F.zip_with(softmax(target, temperature), log_softmax(draft, temperature), lambda p, q: p * q)) * temperature**2


def l1(draft: Column, target: Column) -> Column:
    return _sum(F.zip_with(softmax(draft), softmax(target), lambda p, q: F.abs(p - q)))


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def soft_cap(x: Column, cap: float) -> Column:
    return F.transform(x, lambda v: F.tanh(v / cap) * cap) if cap > 0 else x


def masked(x: Column, keep: Column) -> Column:
    return F.zip_with(x, keep, lambda v, k: F.when(k, v).otherwise(F.lit(0.0)))


def causal_mask(length: Column, anchor: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda p: p <= anchor)


def sliding_mask(length: Column, anchor: Column, window: int) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda p: (p <= anchor) & (p > anchor - window))


def transpose(x: Column) -> Column:
    """``(T, H, D)`` <-> ``(H, T, D)``; rows are of equal length."""
    return F.transform(F.sequence(F.lit(1), F.size(x[0])), lambda h: F.transform(x, lambda t: F.element_at(t, h)))


def step_weights(steps: int, gamma: float) -> list[float]:
    """``exp(-k / gamma)`` per step, unnormalised; all 1 for gamma <= 0."""
    import math

    return [math.exp(-k / gamma) if gamma > 0 else 1.0 for k in range(steps)]
