"""Scores from logits and the losses averaged over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def predict(z: Column, threshold: float = 0.5) -> Column:
    return (sigmoid(z) >= F.lit(threshold)).cast("int")


def bce_with_logits(z: Column, y: Column) -> Column:
    """Stable for large |z|."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_loss(z: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Per-row focal loss; ``avg`` of it is the loss of the set."""
    bce = bce_with_logits(z, y)
    weight = F.lit(alpha) * y + F.lit(1 - alpha) * (1 - y)
    return weight * F.pow(1 - F.exp(-bce), F.lit(gamma)) * bce


def multitask_loss(mse: Column, focal: Column, log_var_reg: float, log_var_cls: float) -> Column:
    """Uncertainty-weighted sum of two averaged losses."""
    reg = F.exp(F.lit(-log_var_reg)) * mse + F.lit(log_var_reg / 2)
    cls = F.exp(F.lit(-log_var_cls)) * focal + F.lit(log_var_cls / 2)
    return reg + cls


def task_weights(log_var_reg: float, log_var_cls: float) -> tuple[Column, Column]:
    """(classification, regression) weights from the two log-variances."""
    c, r = F.exp(F.lit(-log_var_cls)), F.exp(F.lit(-log_var_reg))
    total = c + r + F.lit(1e-12)
    return c / total, r / total
