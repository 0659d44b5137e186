"""Closed-form statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evalspark.constants import KAPPA_LABELS, KAPPA_TOP_LABEL


def rate(passed: Column, total: Column) -> Column:
    return F.try_divide(passed.cast("double"), total.cast("double"))


def kappa(n: Column, agreed: Column, ones_a: Column, ones_b: Column) -> Column:
    """Cohen's kappa for two binary raters from four counts."""
    po, p, q = rate(agreed, n), rate(ones_a, n), rate(ones_b, n)
    pe = p * q + (1 - p) * (1 - q)
    return (
        F.when(n == 0, F.lit(0.0))
        .when(pe >= 1.0, F.when(po >= 1.0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.try_divide(po - pe, 1 - pe))
    )


def kappa_label(value: Column) -> Column:
    label = F.when(value < KAPPA_LABELS[0][0], F.lit(KAPPA_LABELS[0][1]))
    for bound, name in KAPPA_LABELS[1:]:
        label = label.when(value < bound, F.lit(name))
    return label.otherwise(F.lit(KAPPA_TOP_LABEL))


def wilson_bounds(passed: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a pass rate; null without cases."""
    n, p = total.cast("double"), rate(passed, total)
    centre = p + F.try_divide(F.lit(z * z / 2), n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return (centre - spread) / scale, (centre + spread) / scale
