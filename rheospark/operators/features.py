"""Domain features: plateau proxies, carbon-black dispersion, energy labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import number, safe_ratio


def silica_pid(df: DataFrame, temp: str, duration: str, temp_std: str, power: str, torque: str, tref: float = 145.0, trisk: float = 160.0, ea_r: float = 8500.0) -> DataFrame:
    """Exposure of the plateau: linear, by Arrhenius, above the risk temperature; instability, work, torque, validity.

    Where no row at all has a positive power, power counts as 1."""
    t, d, p = number(F.col(temp)), number(F.col(duration), 0.0), number(F.col(power), 0.0)
    dead = df.agg((F.coalesce(F.max(p), F.lit(0.0)) <= 0).alias("_dead"))
    rows = df.join(F.broadcast(dead))
    p = F.when(F.col("_dead"), 1.0).otherwise(p)
    return rows.withColumns({
        "pid_linear": F.greatest(t - tref, F.lit(0.0)) * d,
        "pid_arrhenius": d * F.exp(-ea_r * (1 / (t + 273.15) - 1 / F.lit(tref + 273.15))),
        "pid_over": F.greatest(t - trisk, F.lit(0.0)) * d,
        "pid_instability": safe_ratio(number(F.col(temp_std), 0.0), t),
        "pid_work": p * d, "pid_torque": number(F.col(torque), 0.0),
        "pid_valid": F.coalesce((d > 0) & t.between(100.0, 200.0), F.lit(False)),
    }).drop("_dead")


def cb_v1(df: DataFrame, power: str, duration: str, torque_start: str, torque_end: str, structure: str, energy: str) -> DataFrame:
    n = lambda c: number(F.col(c), 0.0)
    return df.withColumns({
        "cb_work": n(power) * n(duration), "cb_torque_ratio": safe_ratio(n(torque_end), n(torque_start)),
        "cb_structure": n(structure), "cb_decay": safe_ratio(n(torque_start) - n(torque_end), n(duration)), "cb_energy_ratio": safe_ratio(n(energy), n(power) * n(duration)),
    })


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<c> over all rows, by sample deviation; 0 where that is 0 or null. One row of statistics is sent along."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    out = df.join(F.broadcast(stats))
    out = out.withColumns({f"z_{c}": F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def cb_v2(df: DataFrame, loading: str, structure: str, surface: str, power: str, duration: str, power_end: str, speed: str, temp: str) -> DataFrame:
    n = lambda c: number(F.col(c), 0.0)
    rows = zscore(df, [loading, structure, surface])
    rows = rows.withColumn("cb_difficulty", (F.col(f"z_{loading}") + F.col(f"z_{structure}") + F.col(f"z_{surface}")) / 3.0)
    low = rows.agg(F.min("cb_difficulty").alias("_low"))
    rows = rows.join(F.broadcast(low)).withColumn("cb_effective_energy", n(power) * n(duration) / (1 + F.col("cb_difficulty") - F.col("_low")))
    return rows.withColumns({
        "cb_power_decay": safe_ratio(n(power) - n(power_end), n(power)), "cb_shear": n(speed) * n(duration),
        "cb_thermo": n(speed) * n(duration) * number(F.col(temp)) / 100.0,
        "cb_completion": safe_ratio(F.col("cb_effective_energy"), F.col("cb_effective_energy") + n(power)),
    }).drop("_low", f"z_{loading}", f"z_{structure}", f"z_{surface}")


def cb_v21(df: DataFrame, *args: str) -> DataFrame:
    """The compact part of cb_v2."""
    return cb_v2(df, *args).drop("cb_shear", "cb_thermo")


def energy_labels(df: DataFrame, top: str, bottom: str, meter_start: str, meter_end: str, weight: str, low: float = 10.0, high: float = 120.0) -> DataFrame:
    """top and bottom kWh from power integrals (kW s); the meter's difference counts where it is between 5 and 200."""
    kwh = lambda c: number(F.col(c), 0.0) / 3600.0
    meter: Column = F.col(meter_end) - F.col(meter_start)
    usable = F.coalesce((meter > 5) & (meter < 200), F.lit(False))
    out = df.withColumns({"top_kwh": kwh(top), "bottom_kwh": kwh(bottom)})
    out = out.withColumns({"total_kwh": F.when(usable, meter).otherwise(F.col("top_kwh") + F.col("bottom_kwh")), "energy_source": F.when(usable, "METER").otherwise("INTEGRAL")})
    out = out.withColumn("kwh_per_ton", safe_ratio(F.col("total_kwh"), F.col(weight)))
    return out.withColumn("energy_status", F.when(F.col("total_kwh").between(low, high), "VALID").otherwise("OUTLIER"))
