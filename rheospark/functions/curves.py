"""Curves: one array per channel and batch, a value each second. All functions are expressions on arrays.

An index is a position from 0; null means "not found". Nulls in an array are missing values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for n <= 0 (sequence() would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def mean(a: Column) -> Column:
    return let(known(a), lambda k: total(k) / F.nullif(F.size(k), F.lit(0)))


def std_pop(a: Column) -> Column:
    return let(known(a), lambda k: let(total(k) / F.nullif(F.size(k), F.lit(0)), lambda m: F.sqrt(total(k, lambda x: (x - m) * (x - m)) / F.nullif(F.size(k), F.lit(0)))))


def part(a: Column, start: Column, end: Column) -> Column:
    """Values from index start up to, not including, end."""
    return F.slice(a, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))


def trapezoid(a: Column, single: float | None = None) -> Column:
    """Trapezoid integral of the known values at unit steps; a single value is itself (or `single`), none is 0."""
    def area(k: Column) -> Column:
        both = F.zip_with(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))), lambda x, y: (x + y) / 2.0)
        return F.when(F.size(k) == 1, F.get(k, F.lit(0)) if single is None else F.lit(single)).otherwise(total(both))

    return let(known(a), area)


def diffs(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: y - x)


def first_index(a: Column, test: Callable[[Column, Column], Column]) -> Column:
    """First index whose (value, index) passes."""
    return let(a, lambda v: F.get(F.filter(indices(F.size(v)), lambda i: F.coalesce(test(F.get(v, i), i), F.lit(False))), F.lit(0)))


def last_index(a: Column, test: Callable[[Column, Column], Column]) -> Column:
    return let(a, lambda v: let(F.filter(indices(F.size(v)), lambda i: F.coalesce(test(F.get(v, i), i), F.lit(False))), lambda f: F.get(f, F.nullif(F.size(f), F.lit(0)) - 1)))


def decode_hex(text: Column, step: int = 4, strict: bool = False, scale: float = 1.0) -> Column:
    """Numbers of `step` hex digits each; bad chunks are left out, or, if strict, make the whole empty. A shorter last
    chunk counts as a number too."""
    n = F.ceil(F.length(text) / step).cast("int")
    chunks = F.transform(indices(n), lambda i: F.substring(text, i * step + 1, F.lit(step)))
    good = F.filter(chunks, lambda c: c.rlike("^[0-9A-Fa-f]+$"))
    values = F.transform(good, lambda c: F.conv(c, 16, 10).cast("double") * scale)
    empty = F.array().cast("array<double>")
    out = F.when(F.size(good) < n, empty).otherwise(values) if strict else values
    return F.when(text.isNull(), empty).otherwise(out)


def align_channels(df: DataFrame, base: list[str], others: list[str]) -> DataFrame:
    """Cut base channels to the shortest of them; cut or fill up (null) the others to that length."""
    n = F.least(*[F.size(c) for c in base]) if len(base) > 1 else F.size(base[0])
    fill = lambda c: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(None).cast("double"), F.greatest(n - F.size(c), F.lit(0)))), F.lit(1), n)
    return df.withColumns({c: F.slice(c, F.lit(1), n) for c in base} | {c: fill(c) for c in others})


def null_spikes(a: Column, most: float = 10_000.0) -> Column:
    return F.transform(a, lambda x: F.when(x <= most, x))


def null_short_dropouts(points: DataFrame, keys: list[str], time: str, value: str, threshold: float, max_run: int = 3) -> DataFrame:
    """Long form: runs of at most max_run missing or too low values become null; longer runs stay (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(time)
    low = F.coalesce(F.col(value) < threshold, F.lit(True))
    rows = points.withColumn("_low", low).withColumn("_new", F.coalesce((F.col("_low") != F.lag("_low").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    return rows.withColumn(value, F.when(F.col("_low") & (F.col("_n") <= max_run), None).otherwise(F.col(value))).drop("_low", "_new", "_run", "_n")


def interpolate(points: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Long form: linear between known neighbours, constant beyond the ends, 0 where the key has none."""
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    # what follows is what precedes in the reverse order, so that both are running values
    after = Window.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(time).cast("double").alias("t"), F.col(value).alias("v")))
    rows = points.withColumn("_h", here).withColumns({"_a": F.last("_h", ignorenulls=True).over(before), "_b": F.last("_h", ignorenulls=True).over(after)})
    t, a, b = F.col(time).cast("double"), F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))
    filled = F.coalesce(F.col(value), line, a["v"], b["v"], F.lit(0.0))
    return rows.withColumn(value, filled).drop("_h", "_a", "_b")


def resample(a: Column, k: int = 20) -> Column:
    """k points at equal distances, by linear interpolation; zeros for an empty array."""
    def points(v: Column) -> Column:
        place = lambda i: i * (F.size(v) - 1) / (k - 1.0)
        at = lambda i: let(place(i), lambda x: F.get(v, F.floor(x).cast("int")) + (F.get(v, F.ceil(x).cast("int")) - F.get(v, F.floor(x).cast("int"))) * (x - F.floor(x)))
        return F.when(F.size(v) == 0, F.array_repeat(F.lit(0.0), k)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at))

    return let(a, points)


def fill_by_peer_mean(points: DataFrame, group: list[str], time: str, value: str, least: int = 2) -> DataFrame:
    """Long form: a missing value becomes the mean of the group's batches at that second, if enough of them have one.

    The means are an aggregate with a row per group and second, joined back, so that no window holds a whole group."""
    means = points.groupBy(*group, time).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    out = points.join(means, [*group, time], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.when(F.col("_n") >= least, F.col("_m")))).drop("_m", "_n")


def first_drop(a: Column, threshold: float = -5.0, least: int = 10, floor: int = 25, default: int = 30) -> Column:
    """CV8: index behind the first step below the threshold (0 for short curves or none), then `default` if below `floor`."""
    found = F.when(F.size(a) < least, 0).otherwise(F.coalesce(first_index(diffs(a), lambda d, i: d < threshold) + 1, F.lit(0)))
    return let(found, lambda i: F.when(i < floor, default).otherwise(i))


def plateau_start(temp: Column, target: Column, start: Column, near: float = 20.0, hold: float = 30.0, width: int = 5, default: int = 10) -> Column:
    """CV9: first index from start on at target - near whose window stays at target - hold (not tested where the window
    would reach the end); else start + default, at most the last index."""
    def holds(v: Column, i: Column) -> Column:
        return (i + width >= F.size(v)) | F.forall(F.slice(v, i + 1, width), lambda x: x >= target - hold)

    return F.coalesce(let(temp, lambda v: first_index(v, lambda x, i: (i >= start) & (x >= target - near) & holds(v, i))), F.least(start + default, F.size(temp) - 1))


def discharge_start(temp: Column, start: Column) -> Column:
    """CV10: a fall of 10 over 5 s that becomes 15 over 15 s (+ 2); else a step below -10; else below -5; else 5 from the
    end. The last index if start is within 5 of the end."""
    def find(v: Column) -> Column:
        n = F.size(v)
        fall = lambda i, k: F.get(v, i) - F.get(v, i + k)
        long = first_index(v, lambda x, i: (i >= start) & (i < n - 15) & (fall(i, 5) >= 10) & (fall(i, 15) >= 15)) + 2
        step = lambda t: first_index(v, lambda x, i: (i > start) & (i < n - 1) & (fall(i, 1) > t))
        return F.when(start >= n - 5, n - 1).otherwise(F.coalesce(long, step(10), step(5), F.greatest(start + 1, n - 5)))

    return let(temp, find)


def bottom_start(temp: Column, start: Column) -> Column:
    """CV11: from the first least value of the next 80 s on, the first value 3 above it within 100 s (else where it is);
    behind start and before the end."""
    def find(v: Column) -> Column:
        n = F.size(v)
        window = part(v, start, start + 80)
        low = F.array_min(window)
        at = F.coalesce(start + F.array_position(window, low).cast("int") - 1, start)
        rise = let(at, lambda i: F.coalesce(first_index(v, lambda x, j: (j > i) & (j < i + 100) & (x >= low + 3)), i))
        return F.when(start >= n - 3, n - 1).otherwise(F.greatest(start + 1, F.least(rise, n - 1)))

    return let(temp, find)


def bottom_end(temp: Column, power: Column, start: Column) -> Column:
    """CV12: from start on, the earlier of what follows the last power of 50 and more and what follows the largest drop over
    5, each only if more than 5 s after start; else the end."""
    def find(v: Column) -> Column:
        n = F.size(v)
        active = F.coalesce(last_index(power, lambda x, i: (i >= start) & (x >= 50)) + 1, n)
        steps = F.transform(F.filter(indices(n - 1), lambda i: i >= start), lambda i: F.struct((F.get(v, i + 1) - F.get(v, i)).alias("d"), i.alias("i")))
        least = F.array_min(F.filter(steps, lambda x: x["d"] < -5))
        late = lambda x: F.when(x > start + 5, x)
        return F.when(start >= n - 5, n).otherwise(F.coalesce(F.least(late(active), late(least["i"] + 1), n), n))

    return let(temp, find)


def stage_bounds(df: DataFrame, temp: str, ram: str, power: str, target: Column, oil: Column, oil_start: Column | None = None, oil_end: Column | None = None) -> DataFrame:
    """CV13: t1 .. t5 (ends of loading, dry, oil, wet and plateau), bottom_start and bottom_end of each curve.

    oil_start and oil_end are the recipe's step times; missing ones, or such as leave no room on the curve, become t1 + 45
    and 40 later, and they end 15 and 10 before the curve does. Without oil t2 = t3 = t1 and dry mixing lasts until the
    plateau, t4. Forward, a stage that wouldn't follow the one in front begins 5 after it; backward, each ends at least 2
    before the next, from the curve's end on, and none below 0.
    """
    n = F.size(temp)
    none = F.lit(None).cast("double")
    s, e = (none if c is None else c.cast("double") for c in (oil_start, oil_end))
    cut = lambda c, room: F.least(c, n - room)
    after = lambda c, by: F.when(c <= by, by + 5).otherwise(c)
    rows = df.withColumns({"t1": first_drop(F.col(ram)), "_oil": F.coalesce(oil, F.lit(False))})
    t = {i: F.col(f"t{i}") for i in range(1, 6)}
    rows = rows.withColumn("_s", F.when(s.isNull() | (s < t[1] + 10) | (s >= n - 40), t[1] + 45).otherwise(F.bround(s, 0)).cast("int"))
    rows = rows.withColumn("_e", F.when(e.isNull() | (e <= F.col("_s")) | (e >= n - 20), F.col("_s") + 40).otherwise(F.bround(e, 0)).cast("int"))
    rows = rows.withColumn("t2", F.when(F.col("_oil"), after(cut(F.col("_s"), 15), t[1])).otherwise(t[1]))
    rows = rows.withColumn("t3", F.when(F.col("_oil"), after(cut(F.col("_e"), 10), t[2])).otherwise(t[1]))
    rows = rows.withColumn("t4", after(plateau_start(F.col(temp), target, t[3]), t[3]))
    rows = rows.withColumn("t5", after(discharge_start(F.col(temp), t[4]), t[4]))
    rows = rows.withColumn("bottom_start", bottom_start(F.col(temp), t[5]))
    rows = rows.withColumn("t5", F.least(t[5], n)).withColumn("t4", F.least(t[4], t[5] - 2))
    rows = rows.withColumn("t3", F.least(t[3], t[4] - 2)).withColumn("t2", F.when(F.col("_oil"), F.least(t[2], t[3] - 2)).otherwise(t[3]))
    rows = rows.withColumn("t1", F.greatest(F.when(F.col("_oil"), F.least(t[1], t[2] - 2)).otherwise(t[3]), F.lit(0)))
    for i in range(2, 6):
        rows = rows.withColumn(f"t{i}", F.greatest(t[i], t[i - 1]))
    rows = rows.withColumn("bottom_start", F.least(F.greatest(F.col("bottom_start"), t[5]), n))
    end = bottom_end(F.col(temp), F.col(power), F.col("bottom_start"))
    return rows.withColumn("bottom_end", F.when(end <= F.col("bottom_start"), n).otherwise(F.least(end, n))).drop("_s", "_e", "_oil")


STAGES = ["loading", "dry", "oil", "wet", "plateau", "bottom"]


def stage_spans(oil: Column) -> list[tuple[str, Column, Column]]:
    """(stage, start, end) of each stage, from the columns of stage_bounds()."""
    t1, t2, t3, t4, t5 = (F.col(f"t{i}") for i in range(1, 6))
    has = F.coalesce(oil, F.lit(False))
    spans = [(F.lit(0), t1), (t1, F.when(has, t2).otherwise(t4)), (t2, t3), (t3, F.when(has, t4).otherwise(t3)), (t4, t5), (F.col("bottom_start"), F.col("bottom_end"))]
    return [(name, a, b) for name, (a, b) in zip(STAGES, spans, strict=True)]


def stages_long(df: DataFrame, keep: list[str], oil: Column) -> DataFrame:
    """CV14: a row (stage, s, e) for each stage, also those of no length."""
    cells = F.array(*[F.struct(F.lit(name).alias("stage"), a.alias("s"), b.alias("e")) for name, a, b in stage_spans(oil)])
    return df.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.*")


@udtf(returnType="stage string, s int, e int")
class StageTable:
    """stages_long() for SQL, after register_tables(): SELECT ... FROM t, LATERAL stage_table(t1, t2, t3, t4, t5, bottom_start,
    bottom_end, has_oil). Bounds that are null stay null."""

    def eval(self, t1: int, t2: int, t3: int, t4: int, t5: int, bottom_start: int, bottom_end: int, oil: bool):  # noqa: ANN201
        ends = [(0, t1), (t1, t2 if oil else t4), (t2, t3), (t3, t4 if oil else t3), (t4, t5), (bottom_start, bottom_end)]
        for stage, (s, e) in zip(STAGES, ends, strict=True):
            yield stage, s, e


def register_tables(spark: SparkSession) -> None:
    """Table functions for spark.sql: stage_table."""
    spark.udtf.register("stage_table", StageTable)


def stage_stats(df: DataFrame, channels: list[str], integrals: list[str], torque: str = "torque", speed: str = "speed", s: str = "s", e: str = "e") -> DataFrame:
    """Per row with s and e: mean and population deviation of each channel, of eta = torque / speed, integrals, duration."""
    cut = lambda c: part(F.col(c), F.col(s), F.col(e))
    eta = F.zip_with(cut(torque), cut(speed), lambda a, b: F.when(b > 0, a / b))
    out = {f"{c}_mean": mean(cut(c)) for c in channels} | {f"{c}_std": std_pop(cut(c)) for c in channels}
    out |= {"eta_mean": mean(eta), "eta_std": std_pop(eta), "duration": F.greatest(F.col(e) - F.col(s), F.lit(0))}
    return df.withColumns(out | {f"{c}_integral": trapezoid(cut(c)) for c in integrals})


def thermal_metrics(df: DataFrame, temp: str, discharge: Column) -> DataFrame:
    t, n = F.col(temp), F.size(temp)
    top = F.array_max(t)
    at = F.array_position(t, top).cast("int") - 1
    first = F.get(known(t), F.lit(0))
    return df.withColumns({
        "temp_discharge": F.get(t, F.least(discharge, n - 1)), "temp_max": top, "temp_argmax": at, "temp_init": first,
        "temp_rise_rate": (top - first) / F.nullif(at, F.lit(0)), "temp_integral": trapezoid(t, 0.0), "temp_rate_std": std_pop(diffs(t)),
    })


def power_metrics(df: DataFrame, power: str, start: Column, end: Column) -> DataFrame:
    p = F.col(power)
    inside = part(p, start, end)
    return df.withColumns({
        "power_mean": mean(p), "power_integral": trapezoid(p, 0.0), "power_peak": F.array_max(p), "power_argmax": F.array_position(p, F.array_max(p)).cast("int") - 1,
        "power_plateau_cv": std_pop(inside) / F.nullif(mean(inside), F.lit(0.0)), "power_max_drop": F.array_min(diffs(p)),
    })


def viscosity_metrics(df: DataFrame, power: str, speed: str, spans: Mapping[str, tuple[Column, Column]], discharge: Column | None = None) -> DataFrame:
    """CV18: mean apparent viscosity power / speed squared of the whole and of named spans, and its value at discharge."""
    eta = F.zip_with(F.col(power), F.col(speed), lambda a, b: F.when(b > 0, a / (b * b)))
    out = {"visc_mean": mean(F.col("_eta"))} | {f"visc_{n}": mean(part(F.col("_eta"), a, b)) for n, (a, b) in spans.items()}
    if discharge is not None:
        out["visc_discharge"] = F.get("_eta", discharge)
    return df.withColumn("_eta", eta).withColumns(out).drop("_eta")


def time_shares(df: DataFrame, spans: Mapping[str, tuple[Column, Column]], n: Column, discharge: Column) -> DataFrame:
    """CV19: each span's share of the curve's length n, the share behind the discharge, the length and the discharge."""
    share = lambda a, b: (b - a) / F.nullif(n, F.lit(0))
    return df.withColumns({f"share_{name}": share(a, b) for name, (a, b) in spans.items()} | {"share_discharge": share(discharge, n), "total_time": n, "reach_discharge": discharge})


def ram_metrics(df: DataFrame, ram: str, speed: str, discharge: Column) -> DataFrame:
    """CV20: rises of the ram over 10, its mean from the discharge on, the integral of the speed."""
    return df.withColumns({"ram_lifts": F.size(F.filter(diffs(F.col(ram)), lambda d: d > 10)), "ram_stable": mean(part(F.col(ram), discharge, F.size(ram))), "shear_history": trapezoid(F.col(speed), 0.0)})


def slope(a: Column, least: int = 4) -> Column:
    """Least-squares slope of known values over their index; null for fewer than `least`."""
    def fit(v: Column) -> Column:
        pairs = F.filter(F.transform(v, lambda x, i: F.struct(i.cast("double").alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull())

        def of(p: Column) -> Column:
            n = F.size(p).cast("double")
            si, sx = total(p, lambda q: q["i"]), total(p, lambda q: q["x"])
            return F.when(n >= least, (n * total(p, lambda q: q["i"] * q["x"]) - si * sx) / F.nullif(n * total(p, lambda q: q["i"] * q["i"]) - si * si, F.lit(0.0)))

        return let(pairs, of)

    return let(a, fit)


def rheology_metrics(df: DataFrame, power: str, torque: str, speed: str, stage1: tuple[Column, Column], stage2: tuple[Column, Column]) -> DataFrame:
    """CV21: greatest power and torque of stage 1; of a stage 2 of more than 3 s the slope of its known power values, one
    behind the other, and its last known torque / speed."""
    eta = F.zip_with(part(F.col(torque), *stage2), part(F.col(speed), *stage2), lambda a, b: F.when(b > 0, a / b))
    long = stage2[1] > stage2[0] + 3
    return df.withColumns({
        "power_max_1": F.array_max(part(F.col(power), *stage1)), "torque_max_1": F.array_max(part(F.col(torque), *stage1)),
        "power_slope_2": F.when(long, slope(known(part(F.col(power), *stage2)))), "eta_last": F.when(long, F.try_element_at(known(eta), F.lit(-1))),
    })


def specific_energy(df: DataFrame, integrals: Mapping[str, str], solids: str, temp: str, above: float = 100.0) -> DataFrame:
    """CV22: each integral (missing: 0) by the solids, 0 without solids; the trapezoid integral of the degrees above `above`."""
    per = lambda c: F.when(F.col(solids) > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(solids)).otherwise(0.0)
    hot = F.transform(known(F.col(temp)), lambda x: F.greatest(x - above, F.lit(0.0)))
    return df.withColumns({f"{n}_specific_energy": per(c) for n, c in integrals.items()} | {"thermal_above": trapezoid(hot, 0.0)})


def invalid_reason(temp: Column, speed: Column, power: Column, torque: Column, ram: Column, spans: list[tuple[str, Column, Column, Column]]) -> Column:
    """The first test that a curve fails; null for a valid one. spans: (stage, start, end, present), in order."""
    found = None

    def test(condition: Column, reason: str) -> None:
        nonlocal found
        hit = F.coalesce(condition, F.lit(False))
        found = F.when(hit, reason) if found is None else found.when(hit, reason)

    for name, a, b, there in spans:
        test(there & (b - a < 3), f"{name}: too short")
        test(there & (b - a > 300), f"{name}: too long")
    test((F.array_min(temp) < 15) | (F.array_max(temp) > 250), "temperature out of range")
    by_name = {name: (a, b, there) for name, a, b, there in spans}
    if "loading" in by_name and "plateau" in by_name:
        (a, b, first), (c, d, last) = by_name["loading"], by_name["plateau"]
        test(first & last & (mean(part(temp, c, d)) <= mean(part(temp, a, b)) + 10), "no heating")
    for name, a, b, there in spans:
        if name in ("dry", "oil", "wet", "plateau"):
            test(there & (mean(part(speed, a, b)) < 10), f"{name}: speed too low")
    for name, a, b, there in spans:
        if name in ("dry", "wet", "plateau"):
            test(there & ((mean(part(power, a, b)) < 10) | (mean(part(torque, a, b)) < 10)), f"{name}: power or torque too low")
    for name, a, b, there in spans:
        if name != "bottom":
            cut = part(ram, a, b)
            test(there & (F.array_max(cut) < 10), f"{name}: ram at zero")
            test(there & (std_pop(cut) < 0.01) & (mean(cut) < 20), f"{name}: ram flat")
    return found


def curve_valid(df: DataFrame, temp: str, speed: str, power: str, torque: str, ram: str, spans: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """CV23: reason (null for a valid curve) and valid."""
    return df.withColumn("reason", invalid_reason(*map(F.col, (temp, speed, power, torque, ram)), spans)).withColumn("valid", F.col("reason").isNull())


def reason_counts(df: DataFrame) -> DataFrame:
    """CV24: curves by reason."""
    return df.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def sticky_batches(df: DataFrame, temp: str, discharge: Column, least: int = 250, near: int = 10, head: int = 35, warm: float = 50.0) -> DataFrame:
    """CV25: long curves, warm in their first `head` seconds, whose discharge is found only within `near` of the end. The
    discharge stands behind an explode of one value: a filter on it alone would be moved to where the curve begins, with the
    steps that lead to it written out as often as they are used, which multiplies from step to step."""
    started = (F.size(temp) >= head) & F.exists(F.slice(temp, 1, head), lambda x: x > warm)
    rows = df.where(started & (F.size(temp) > least)).select("*", F.explode(F.array(discharge)).alias("_discharge"))
    return rows.where(F.col("_discharge") >= F.size(temp) - near).drop("_discharge")


def arrhenius_dose(temp: Column, energy: float = 75_000.0, reference: float = 150.0, low: float = 135.0, gas: float = 8.314) -> Column:
    """Sum over seconds from `low` on, within 20 to 200 degrees, of the rate to that at the reference temperature."""
    kept = F.filter(temp, lambda x: (x >= low) & x.between(20.0, 200.0))
    return total(kept, lambda x: F.exp(-energy / gas * (1 / (x + 273.15) - 1 / (reference + 273.15))))


def fraction_features(df: DataFrame, channels: list[str], cuts: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Mean, deviation and maximum of each channel as a whole and in fixed fractions of its length."""
    out = {}
    for c in channels:
        n = F.size(c)
        out |= {f"{c}_mean": mean(F.col(c)), f"{c}_std": std_pop(F.col(c)), f"{c}_max": F.array_max(c)}
        for name, (a, b) in cuts.items():
            inside = part(F.col(c), F.floor(n * a).cast("int"), F.floor(n * b).cast("int"))
            out |= {f"{c}_{name}_mean": mean(inside), f"{c}_{name}_std": std_pop(inside)}
    return df.withColumns(out)


def curve_vector(channels: list[Column], bounds: list[tuple[Column, Column]], k: int = 20, zero: Iterable[tuple[int, int]] = ()) -> Column:
    """CV28: stage by stage and channel by channel k points each, in one array; zeros for the (stage, channel) in `zero`."""
    cell = lambda i, j: F.array_repeat(F.lit(0.0), k) if (i, j) in zero else resample(part(channels[j], *bounds[i]), k)
    return F.flatten(F.array(*[cell(i, j) for i in range(len(bounds)) for j in range(len(channels))]))


def curve_agg(points: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    num = lambda c: F.col(c).try_cast("double")
    return points.groupBy(*keys).agg(*[F.avg(num(c)).alias(f"{c}_avg") for c in channels], *[F.max(num(c)).alias(f"{c}_max") for c in channels])


def duration_audit(stages: DataFrame, stage: str, duration: str, conditional: list[str], most: float = 300.0) -> DataFrame:
    """Per stage min, max, mean, sample deviation (of positive ones only for conditional stages) and absurd ones."""
    value = F.when(~F.col(stage).isin(*conditional) | (F.col(duration) > 0), F.col(duration))
    absurd = F.count_if((F.col(duration) < 0) | (F.col(duration) > most))
    return stages.groupBy(stage).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), absurd.alias("n_absurd"))
