"""Training arithmetic as column expressions: schedules, losses, sampling masks and array kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lr_multiplier(step: Column, total: int, warmup: int, kind: str, least: float, decay_fraction: float = 0.2) -> Column:
    """Of the base rate, at a step from 0: a linear warm-up, then a cosine or a plateau with a linear end, down to `least`."""
    if total <= warmup or total <= 0:
        raise ValueError("the schedule must be longer than its warm-up")
    rest = total - warmup
    warm = (step + 1) / F.lit(float(max(1, warmup)))
    if kind == "cosine":
        progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, rest - 1))))
        after = least + (1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    elif kind == "wsd":
        decay = max(1, math.ceil(rest * decay_fraction))
        into = step - warmup - (rest - decay)
        falling = F.lit(least) if decay == 1 else 1 - (1 - least) * F.least(F.lit(1.0), into / F.lit(float(decay - 1)))
        after = F.when(into < 0, F.lit(1.0)).otherwise(falling)
    else:
        raise ValueError(f"unknown schedule {kind!r}")
    return F.when(step < warmup, warm).otherwise(after)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, not once for each element of a lambda inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top))))


def cross_entropy(logits: Column, target: Column) -> Column:
    return log_sum_exp(logits) - F.element_at(logits, target + 1)


def z_loss(logits: Column) -> Column:
    return F.pow(log_sum_exp(logits), 2)


def masked(logits: Column, blocked: list[int]) -> Column:
    """Blocked places become null, which every function here leaves out."""
    return F.transform(logits, lambda v, i: F.when(~i.isin(blocked), v) if blocked else v)


def softmax(logits: Column, temperature: float) -> Column:
    weights = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.coalesce(F.exp((v - top) / temperature), F.lit(0.0))))
    return let(weights, lambda w: let(_sum(w), lambda total: F.transform(w, lambda x: x / total)))


def top_k(logits: Column, k: int) -> Column:
    """Values under the k-th largest become null; ties with it stay."""
    ranked = F.sort_array(F.array_compact(logits), asc=False)
    cutoff = let(ranked, lambda r: F.element_at(r, F.least(F.lit(k), F.size(r))))
    return let(cutoff, lambda c: F.transform(logits, lambda v: F.when(v >= c, v)))


def clip_factor(norm: Column, limit: float, eps: float = 1e-6) -> Column:
    return F.least(F.lit(1.0), limit / (norm + eps))


def rope(values: Column, position: Column, base: float = 10000.0) -> Column:
    """Neighbouring pairs turned by position * base ** (-2 i / d)."""
    d = F.size(values)
    angle = lambda i: position * F.pow(F.lit(base), -2.0 * F.floor(i / 2) / d)
    at = lambda i: F.element_at(values, i + 1)
    return F.transform(values, lambda v, i: F.when(i % 2 == 0, v * F.cos(angle(i)) - at(F.least(i + 1, d - 1)) * F.sin(angle(i))).otherwise(at(i - i % 2) * F.sin(angle(i)) + v * F.cos(angle(i))))


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / F.size(values) + eps)
    return let(scale, lambda s: F.transform(values, lambda v: v / s))


def causal_convolution(values: Column, weights: list[float]) -> Column:
    """Each value plus the weighted sum of itself and those before it; the last weight is the value's own."""
    k = len(weights)

    def around(i: Column) -> Column:
        terms = [F.coalesce(F.get(values, i - (k - 1 - j)), F.lit(0.0)) * w for j, w in enumerate(weights)]
        return sum(terms[1:], terms[0])

    return F.transform(values, lambda v, i: v + around(i))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: g / (1 + F.exp(-g)) * u)
