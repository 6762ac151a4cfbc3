"""When a level's passes stop: rules over run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plateau(reports: DataFrame, value: str, n: int, rel: float, after: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds `plateau`: whether the value fell by less than rel of what it was n passes earlier.

    Waits for iteration >= after + n. Order is by iteration in a level, a few rows each.
    """
    order = Window.partitionBy(*keys).orderBy("iteration")
    old = F.lag(value, n).over(order)
    fires = (old - F.col(value) < rel * old) & (F.col("iteration") >= after + n)
    return reports.withColumn("plateau", F.coalesce(fires, F.lit(False)))


def stop_held(d99: Column, threshold: Column, plateau_: Column, iteration: Column, cap: Column, gave_up: Column, spacing: float, residual_vox: float = 0.5, subvoxel: bool = True) -> Column:
    """The reason to stop when the template is held, null to go on."""
    rule = F.when(gave_up, "folds").when(d99 < residual_vox * spacing, "residual").when(plateau_, "plateau")
    if not subvoxel:
        rule = rule.when((threshold > 0) & (d99 < threshold), "fits")
    return rule.when(iteration + 1 >= cap, "cap")


def stop_estimated(d99: Column, step: Column, threshold: Column, plateau_: Column, iteration: Column, cap: Column, last: Column, spacing: float, ubar_vox: float = 0.1) -> Column:
    """The reason to stop when the template is estimated, null to go on."""
    converged = step < ubar_vox * spacing
    fits = (threshold > 0) & (d99 < threshold)
    return F.when(converged & (last | fits), "converged").when(plateau_, "plateau").when(iteration + 1 >= cap, "cap")


def annealed(iteration: Column, start: float, end: float, n: int) -> Column:
    """A geometric schedule from start to end over n passes, end from then on."""
    if n <= 1:
        return F.lit(float(end))
    return F.lit(float(start)) * F.pow(F.lit(float(end) / start), F.least(iteration / (n - 1.0), F.lit(1.0)))
