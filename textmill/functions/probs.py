"""Column expressions over probability vectors, logits and training schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.schemas import DEFAULT_SOFT


def default_soft(p: Column, default: tuple[float, ...] = DEFAULT_SOFT) -> Column:
    return F.coalesce(p, F.array(*map(F.lit, default)))


def argmax(p: Column) -> Column:
    """Place of the largest value, the first of equal ones; null for null and empty arrays."""
    place = F.array_position(p, F.array_max(p)).cast("int")
    return F.when(place > 0, place - 1)


def confidence(p: Column) -> Column:
    return F.array_max(default_soft(p))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def normalize3(negative: Column, neutral: Column, positive: Column) -> Column:
    """[negative, neutral, positive] scaled to sum 1: a missing value counts .33; a sum of 0 gives [.34, .33, .33]."""
    part = F.array(*(F.coalesce(x.cast("double"), F.lit(0.33)) for x in (negative, neutral, positive)))
    s = total(part)
    return F.when(s > 0, F.transform(part, lambda x: x / s)).otherwise(F.array(F.lit(0.34), F.lit(0.33), F.lit(0.33)))


def calibrate_neutral(p: Column, threshold: float = 0.6, gap: float = 0.2) -> Column:
    """``struct(label, is_uncertain)``: below ``threshold`` it is uncertain, and neutral if the two best are within ``gap``."""
    down = F.sort_array(p, asc=False)
    unsure = F.array_max(p) < threshold
    close = (F.get(down, 0) - F.get(down, 1)) < gap
    return F.struct(F.when(unsure & close, 1).otherwise(argmax(p)).cast("int").alias("label"), unsure.alias("is_uncertain"))


def adaptive_temperature(c: Column, version: int = 1) -> Column:
    """Distillation temperature of a teacher confidence."""
    if version == 1:
        return F.when(c > 0.9, 1.5).when(c > 0.6, 2.0).otherwise(F.least(2.5 + (0.6 - c) * 2.0, F.lit(3.0)))
    if version == 2:
        return F.when(c > 0.85, 1.2).when(c > 0.6, 1.8).otherwise(F.least(2.0 + (0.6 - c) * 3.0, F.lit(4.0)))
    return 3.0 - 2.0 * c


def log_softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    scaled = F.transform(z, lambda x: x / t)
    top = F.array_max(scaled)
    norm = top + F.log(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.transform(scaled, lambda x: x - norm)


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(log_softmax(z, temperature), lambda x: F.exp(x))


def kl_divergence(p: Column, log_q: Column) -> Column:
    """Sum of p (ln p - ln q) with 0 ln 0 = 0."""
    terms = F.zip_with(p, log_q, lambda a, b: F.when(a > 0, a * (F.log(a) - b)).otherwise(F.lit(0.0)))
    return total(terms)


def cross_entropy(z: Column, label: Column) -> Column:
    """-ln softmax(z)[label]; null for a label outside the vector."""
    return -F.get(log_softmax(z), label)


def mixed_loss(kl_mean: Column, ce_mean: Column, alpha: float = 0.7) -> Column:
    """alpha KL + (1 - alpha) CE; cross entropy alone where no row has a soft label."""
    return F.when(kl_mean.isNull(), ce_mean).otherwise(alpha * kl_mean + (1 - alpha) * ce_mean)


def layer_rates(rate: float, decay: float, layers: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda i: F.lit(rate) * F.pow(F.lit(decay), F.lit(layers) - i))


def schedule(rows: Column, batch: int, accumulate: int, epochs: int, warm: float = 0.05) -> Column:
    """``struct(total_steps, warmup_steps)``."""
    steps = F.floor(F.floor(rows / F.lit(batch * accumulate))) * epochs
    return F.struct(steps.cast("long").alias("total_steps"), F.greatest(F.lit(1), F.floor(steps * warm)).cast("long").alias("warmup_steps"))
