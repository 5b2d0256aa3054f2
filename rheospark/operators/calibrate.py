"""Calibration by late feedback: EWMA with change points, Kalman filters, order offsets. Each emits before it learns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_rows
from ..sources.io import cut
from .scans import affine_scan, dealt, running_top
from .windows import rolling_offset


def alpha_of(feedback: Column, before: Column, jump: float = 2.0, same: float = 2.5, fast: float = 0.65, slow: float = 0.2, first: float = 0.3) -> Column:
    """Learning rate of a feedback: fast at a jump, or at a large value with the sign of the one before."""
    changed = (F.abs(feedback - before) >= jump) | ((F.signum(feedback) == F.signum(before)) & (F.abs(feedback) >= same) & (F.abs(before) >= same))
    return F.when(before.isNull(), first).when(changed, fast).otherwise(slow)


def ewma_calibrate(df: DataFrame, keys: list[str], order: list[str], y: str, p: str, k: int = 3, most: float = 4.0, parts: int | None = None) -> DataFrame:
    """CA1: correction (clipped state before the row) and calibrated prediction. The k-th labelled residual back, the row's own
    counted, is the feedback a labelled row learns from, at a rate that depends on the feedback before it alone. So a
    row's update is a linear map, and a key of any size is scanned in many tasks (scans.py)."""
    res = F.col("_res")
    rows = df.withColumn("_res", (F.col(y) - F.col(p)).cast("double"))
    rows, chunks = dealt(cut(rows, "rows"), keys, order, parts)
    rows = rows.withColumn("_x", F.when(res.isNotNull(), F.struct(*order, "_res")))
    rows = running_top(rows, keys, order, "_x", k, "_back", chunks=chunks)
    back = lambda i: F.when(res.isNotNull(), res if i == 0 else F.get("_back", F.lit(i - 1))["_res"])
    rows = rows.withColumns({"_f": back(k - 1), "_g": back(k)})
    rate = F.when(F.col("_f").isNotNull(), alpha_of(F.col("_f"), F.col("_g"))).otherwise(0.0)
    out = affine_scan(rows.withColumn("_rate", rate), keys, order, {"_state": (1 - F.col("_rate"), F.coalesce(F.col("_rate") * F.col("_f"), F.lit(0.0)), 0.0)}, chunks=chunks)
    correction = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("_state")))
    return out.withColumns({"correction": correction, "calibrated": F.col(p) + correction}).drop("_res", "_x", "_back", "_f", "_g", "_rate", "_state", "_key", "_part")


def variance_after(n: Column, q: float, r: float, first: float = 1.0) -> Column:
    """Variance of a Kalman filter with process noise q and measurement noise r after n measurements. Each one takes v to
    r (v + q) / (v + q + r), whatever was measured: a Moebius map, whose n-th power is known from its fixed points."""
    if q == 0:
        return 1 / (1 / first + n / r)
    d = math.sqrt(q * q + 4 * q * r)
    a, b = (d - q) / 2, (-d - q) / 2
    w = F.pow(F.lit((r - a) / (r - b)), n) * ((first - a) / (first - b))
    return (a - b * w) / (1 - w)


def kalman_calibrate(df: DataFrame, keys: list[str], order: list[str], y: str, p: str, q: float = 0.01, r: float = 1.0, alpha: float = 0.2, most: float = 6.0, parts: int | None = None) -> DataFrame:
    """CA2: kalman and ewma bias before each row, clipped. The gain depends on the number of residuals before alone, so both are
    linear maps and scanned like CA1's."""
    known = F.col("_res").isNotNull()
    rows, chunks = dealt(cut(df.withColumn("_res", (F.col(y) - F.col(p)).cast("double")), "rows"), keys, order, parts)
    linear = lambda gain: (F.when(known, 1 - gain).otherwise(1.0), F.coalesce(gain * F.col("_res"), F.lit(0.0)), 0.0)
    rows = affine_scan(rows, keys, order, {"_n": (F.lit(1.0), known.cast("double"), 0.0), "_e": linear(F.lit(alpha))}, chunks=chunks)
    var = variance_after(F.col("_n"), q, r) + q
    rows = affine_scan(rows.withColumn("_gain", var / (var + r)), keys, order, {"_b": linear(F.col("_gain"))}, chunks=chunks)
    clip = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.col(c)))
    return rows.withColumns({"kalman": clip("_b"), "ewma": clip("_e")}).drop("_res", "_n", "_e", "_gain", "_b", "_key", "_part")


def adaptive_kalman(df: DataFrame, keys: list[str], order: list[str], y: str, p: str, noise: float = 3.0, shift: float = 1.8, drift: float = 0.2, most_gain: float = 0.75) -> DataFrame:
    """CA3: Kalman bias with gain 0.10 for innovations above `noise`, half more above `shift`, at most `most_gain`.
    The gain depends on the state itself, so there is no map to compose: a key is one task's, which holds two numbers."""
    rows = df.withColumn("_res", (F.col(y) - F.col(p)).cast("double"))

    def step(s: tuple, x: tuple) -> tuple:
        (bias, var), (res,) = s, x
        if res is None:
            return s
        off, var = abs(res - bias), var + drift
        plain = var / (var + 1.0)
        gain = 0.10 if off > noise else min(1.5 * plain if off > shift else plain, most_gain)
        return bias + gain * (res - bias), (1 - gain) * var

    out = fold_rows(rows, keys, order, ["_res"], (0.0, 1.0), step, ["bias", "_v"])
    return out.withColumn("calibrated", F.col(p) + F.col("bias")).drop("_res", "_v")


def order_offset(df: DataFrame, keys: list[str], order: list[Column], y: str, p: str, state: DataFrame | None = None, most: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Rows with offset (the order's last residual, else the carried one, else 0) and the new state; residuals beyond
    `most` aren't learned. state: keys, carried."""
    res = F.col(y) - F.col(p)
    rows = df.withColumn("_res", F.when(F.abs(res) <= most, res))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_off", F.last("_res", ignorenulls=True).over(own))
    rows = rows.join(state, keys, "left") if state is not None else rows.withColumn("carried", F.lit(None).cast("double"))
    out = rows.withColumn("offset", F.coalesce("_off", "carried", F.lit(0.0))).withColumn("calibrated", F.col(p) + F.col("offset"))
    last = out.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    new = last.where("_res is not null").groupBy(*keys).agg(F.max_by("_res", "_rn").alias("carried"))
    return out.drop("_res", "_off", "carried"), new


def alpha_policy(scenario: Column) -> Column:
    """Learning rate by scenario; rejected feedback teaches nothing."""
    rates = {"change_point": 0.60, "fast": 0.40, "normal": 0.25, "stable": 0.15}
    out = None
    for name, rate in rates.items():
        out = F.when(scenario == name, rate) if out is None else out.when(scenario == name, rate)
    return out.otherwise(0.0)


__all__ = ["adaptive_kalman", "alpha_of", "alpha_policy", "ewma_calibrate", "kalman_calibrate", "order_offset", "rolling_offset"]
