"""Scalar functions over columns: names, keys, classes, ratios, gates. All are plain expressions that Catalyst compiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Material classes by prefix of the code; the first match counts.
MATERIAL_PREFIXES = [
    ("silica", "CS100", None),
    ("oil", "CS", None),
    ("silane", "CA551", None),
    ("natural_rubber", "CN", None),
    ("elastomer", "CE", "CE19"),
    ("carbon_black", "CB", None),
    ("masterbatch", "CC", None),
    ("ctp", "CTP", None),
]


def number(column: Column, default: float | None = None) -> Column:
    """Double, NaN and what is no number as null (or the default)."""
    value = F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def safe_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """a / b times scale; null where b is 0 or null."""
    return F.when(b != 0, scale * a / b)


def prefer(*columns: Column) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)


def clip(column: Column, low: float | None, high: float | None) -> Column:
    """Within low and high; null stays null."""
    out = column
    if low is not None:
        out = F.when(column.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(column.isNotNull(), F.least(out, F.lit(high)))
    return out


def half_even(column: Column, digits: int = 0) -> Column:
    """Rounded as numpy and SQL's round_even do it: the double times a power of ten, to the nearest integer. F.bround takes the
    shortest decimal instead, so that 1.015 is a tie there, and is not here (1.015 * 100 is below 101.5)."""
    unit = float(10**digits)
    return F.rint(column * unit) / unit


def valid_lab_test(variable: str, statuses: Iterable[str], name_like: str, equipment: Iterable[str] | None, since: str, r: Mapping[str, str]) -> Column:
    """Predicate of usable lab tests: variable, status, name pattern (case doesn't count), equipment, date."""
    out = (F.col(r["variable"]) == variable) & F.col(r["status"]).isin(*statuses) & F.upper(F.col(r["name"])).like(name_like.upper())
    if equipment is not None:
        out = out & F.col(r["equipment"]).isin(*equipment)
    return out & (F.col(r["time"]) >= F.lit(since).cast("timestamp"))


def filter_lab(df: DataFrame, *args, **kwargs) -> DataFrame:
    return df.where(valid_lab_test(*args, **kwargs))


def material_class(code: Column, name: Column | None = None, default: str = "other") -> Column:
    """Class by the prefix of the code in upper case; a prefix to exclude makes no match."""
    upper = F.upper(F.trim(code))
    out = None
    for kind, prefix, but in MATERIAL_PREFIXES:
        test = upper.startswith(prefix)
        if but:
            test = test & ~upper.startswith(but)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    if name is not None:
        out = out.when(F.upper(name).contains("SILICA"), "silica").when(F.upper(name).contains("OIL"), "oil")
    return out.otherwise(default)


def known_lots(df: DataFrame, classes: Iterable[str], class_column: str, lot: str) -> DataFrame:
    return df.where(F.col(class_column).isin(*classes) & F.col(lot).isNotNull() & (F.trim(F.col(lot)) != ""))


def clean_code(name: Column) -> Column:
    """The first two parts between hyphens."""
    return F.concat_ws("-", F.slice(F.split(F.trim(name), "-"), 1, 2))


def is_main_mix(name: Column) -> Column:
    return clean_code(name).rlike("^(M1|R1)-")


def compound_family(name: Column) -> Column:
    """First word, hyphens at its end removed; Unknown for null and blank."""
    first = F.regexp_replace(F.get(F.split(F.trim(name), " "), F.lit(0)), "-+$", "")
    return F.when(first.isNull() | (first == ""), "Unknown").otherwise(first)


def family_by_pattern(name: Column, pattern: str = r"([A-Z]\d-[A-Z]\d{5})", width: int = 12) -> Column:
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found == "", F.substring(name, 1, width)).otherwise(found)


def clean_compound(name: Column) -> Column:
    """What stands before --- or --."""
    return F.trim(F.substring_index(F.substring_index(name, "---", 1), "--", 1))


def base_compound(name: Column, width: int = 14) -> Column:
    return F.regexp_replace(F.substring(name, 1, width), "^R1", "M1")


def norm_order_id(order: Column) -> Column:
    """The id without a year and ~ before it."""
    return F.try_element_at(F.split(F.trim(order.cast("string")), "~"), F.lit(-1))


def batch_key(order: Column, batch: Column) -> Column:
    return F.concat_ws("_", order.cast("string"), F.lpad(batch.cast("string"), 4, "0"))


def parse_batch_key(key: Column) -> tuple[Column, Column]:
    """Order and batch number; null number if the last part is none."""
    return F.regexp_extract(key, r"^(.*)_[^_]*$", 1), F.regexp_extract(key, r"_([^_]*)$", 1).try_cast("int")


def qm_category(text: Column, material: Column) -> Column:
    """Category of a quality parameter by its text and its material's class."""
    t, kind = F.upper(text), material_class(material)
    return (
        F.when(t.contains("STSA") & (kind == "carbon_black"), "cb_stsa")
        .when(t.contains("IODINE") & (kind == "carbon_black"), "cb_iodine")
        .when(t.contains("OAN") | t.contains("OIL ABSORPTION"), "cb_structure")
        .when(t.contains("BET") & (kind == "silica"), "silica_bet")
        .when(t.contains("CTAB") & (kind == "silica"), "silica_ctab")
        .when(t.contains("MOISTURE"), "moisture")
        .when(t.contains("VISCOSITY"), "polymer_viscosity")
    )


def material_system(name: Column, silica: Column, black: Column) -> Column:
    """Silica or CarbonBlack: by prefix of the name, else by the larger amount, else by keywords."""
    upper = F.upper(F.trim(name))
    a, b = F.coalesce(silica, F.lit(0.0)), F.coalesce(black, F.lit(0.0))
    return (
        F.when(upper.startswith("SI"), "Silica").when(upper.startswith("CB"), "CarbonBlack")
        .when(a > b, "Silica").when(b > a, "CarbonBlack")
        .when(upper.contains("SILICA"), "Silica").otherwise("CarbonBlack")
    )


def silica_flag(phr: Column, silane: Column, least: float = 25.0) -> Column:
    return F.coalesce((phr >= least) & (silane > 0), F.lit(False))


def oil_flag(share: Column, least: float = 5.0) -> Column:
    return F.coalesce(share >= least, F.lit(False))


def phase_route(oil_duration: Column, wet_duration: Column) -> Column:
    return F.when((F.coalesce(oil_duration, F.lit(0.0)) > 0) | (F.coalesce(wet_duration, F.lit(0.0)) > 0), "oil").otherwise("dry")


def route_tracks(df: DataFrame, history: DataFrame, flags: list[str], parent: str, least: int = 120) -> DataFrame:
    """Track of each row from its flags; the track of `parent` (a flag) alone where history has fewer than `least` rows of
    the full track, and "global" where the parent has too few as well. The counts have a row per track."""
    full = F.concat_ws("/", *[F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in flags])
    short = F.concat(F.lit(f"{parent}="), F.col(parent).cast("string"))
    n_full = history.groupBy(full.alias("full")).agg(F.count("*").alias("n_full"))
    n_short = history.groupBy(short.alias("short")).agg(F.count("*").alias("n_short"))
    out = df.withColumns({"full": full, "short": short}).join(n_full, "full", "left").join(n_short, "short", "left")
    track = F.when(F.coalesce("n_full", F.lit(0)) >= least, F.col("full")).when(F.coalesce("n_short", F.lit(0)) >= least, F.col("short")).otherwise("global")
    return out.withColumn("track", track).drop("full", "short", "n_full", "n_short")


def add_products(df: DataFrame, specs: Mapping[str, Iterable[str]]) -> DataFrame:
    """New columns that are products of others."""
    out = {}
    for name, factors in specs.items():
        product = F.lit(1.0)
        for f in factors:
            product = product * F.col(f)
        out[name] = product
    return df.withColumns(out)


def gate(df: DataFrame, flag: str, value, specs: Mapping[str, str]) -> DataFrame:
    """New columns with another's value where the flag has the given value, else 0."""
    return df.withColumns({new: F.when(F.col(flag) == F.lit(value), F.coalesce(F.col(old), F.lit(0.0))).otherwise(0.0) for new, old in specs.items()})


def recipe_ratios(df: DataFrame, rubber: list[str], natural: str, filler: list[str], oil: str, unknown_as_null: bool = True) -> DataFrame:
    """nr_share, filler_polymer, oil_polymer, oil_filler; null rather than 0 where all inputs are unknown."""
    total = lambda cs: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    polymer, fill, o = total(rubber), total(filler), F.coalesce(F.col(oil), F.lit(0.0))
    unknown = F.coalesce(*[F.col(c) for c in {*rubber, *filler, oil}]).isNull()
    value = lambda a, b: F.when(unknown & F.lit(unknown_as_null), None).otherwise(F.coalesce(safe_ratio(a, b), F.lit(0.0)))
    return df.withColumns({"nr_share": value(F.coalesce(F.col(natural), F.lit(0.0)), polymer), "filler_polymer": value(fill, polymer), "oil_polymer": value(o, polymer), "oil_filler": value(o, fill)})


def one_hot(df: DataFrame, column: str, vocabulary: Iterable[str], missing: str = "missing") -> DataFrame:
    """A 0/1 column for each value of a fixed vocabulary, and one for null."""
    cells = {f"{column}_{v}": (F.coalesce(F.col(column).cast("string"), F.lit(missing)) == F.lit(v)).cast("int") for v in [*vocabulary, missing]}
    return df.withColumns(cells)


def present(df: DataFrame, allowed: Iterable[str] = (), prefixes: Iterable[str] = ()) -> list[str]:
    """Columns of df on an allow-list or with one of the prefixes, in the order of df."""
    names, starts = set(allowed), tuple(prefixes)
    return [c for c in df.columns if c in names or (starts and c.startswith(starts))]


def project(df: DataFrame, keys: list[str], allowed: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    return df.select(*dict.fromkeys([*keys, *present(df, allowed, prefixes)]))


def project_policy(df: DataFrame, policy: Mapping[str, set[str]], mode: str, keys: list[str]) -> DataFrame:
    """Columns that a mode may use; ValueError if a forbidden one is asked for by the policy of no mode."""
    unknown = [c for c in df.columns if c not in policy and c not in keys]
    if unknown:
        raise ValueError(f"no policy for {unknown}")
    return df.select(*keys, *[c for c in df.columns if c not in keys and mode in policy[c]])


def recipe_code(compound: Column, amounts: list[Column]) -> Column:
    return F.concat_ws("-", compound, *[F.bround(F.coalesce(a, F.lit(0.0)), 1).cast("string") for a in amounts])


def rewrite_lot(lot: Column, prefix: str = "9000") -> Column:
    return F.when(F.length(lot) >= 4, F.concat(F.lit(prefix), F.substring(lot, 5, 1 << 20))).otherwise(lot)


def sample_to_batch_120(sample: Column, most_of_pallet: Column, most_of_order: Column) -> Column:
    """Batch of a sample where five batches give six samples."""
    at = F.when(sample <= 2, 1).when(sample == 3, 2).otherwise(F.floor(sample / 1.2 - 1)).cast("int")
    return F.least(at, most_of_pallet, most_of_order)


def out_of_tolerance(df: DataFrame, target: str, actual: str, tolerance: str, share: float = 0.015, least: float = 5.0) -> DataFrame:
    t, off = F.col(target), F.abs(F.col(actual) - F.col(target))
    return df.where((off > F.col(tolerance)) & (off > share * t) & (t > least)).distinct()


def safe_net(df: DataFrame, peak: str, rate_std: str, null_passes: bool, most: float = 65_000.0, least: float = 0.01) -> DataFrame:
    return df.where(F.coalesce(F.col(peak) < most, F.lit(null_passes)) & F.coalesce(F.col(rate_std) > least, F.lit(null_passes)))


def valid_stage_order(df: DataFrame, durations: list[str], indices: list[str]) -> DataFrame:
    """Rows without a negative duration or an index below the one before it; nulls pass."""
    bad = F.lit(False)
    for d in durations:
        bad = bad | F.coalesce(F.col(d) < 0, F.lit(False))
    for a, b in zip(indices, indices[1:], strict=False):
        bad = bad | F.coalesce(F.col(b) < F.col(a), F.lit(False))
    return df.where(~bad)


def eligible_batch(df: DataFrame, quality: str, durations: list[str], weight: str, fill: str) -> DataFrame:
    keep = F.coalesce(F.col(quality), F.lit(False)) & F.coalesce(F.col(weight).between(0.05, 1.0), F.lit(False)) & F.coalesce((F.col(fill) > 0) & (F.col(fill) <= 100), F.lit(False))
    for d in durations:
        keep = keep & (F.coalesce(F.col(d), F.lit(0.0)) >= 0)
    return df.where(keep)


def pid_quality(df: DataFrame, valid: str, instability: str, contribution: str, most: float = 1.0) -> DataFrame:
    ok = F.coalesce(F.col(valid), F.lit(False)) & F.coalesce(F.col(instability) <= most, F.lit(False))
    return df.withColumns({"pid_status": F.when(ok, "PASSED").otherwise("FAILED_LOW_QUALITY"), "pid_confidence": F.when(ok, "HIGH").otherwise("LOW"), contribution: F.when(ok, F.col(contribution)).otherwise(0.0)})


def reason_code(thermal: Column, mechanical: Column, low: float = -0.4, high: float = 0.4, least: float = 0.3) -> Column:
    return F.when(thermal <= low, "OVER_SILANISED").when(thermal >= high, "UNDER_SILANISED").when(F.abs(mechanical) >= least, "DISPERSION").otherwise("NORMAL")


def match_window(df: DataFrame, rules: list[tuple[str, Column]], default: str = "NONE") -> DataFrame:
    """Name of the first rule, in order, whose condition holds."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return df.withColumn("window", out.otherwise(default) if out is not None else F.lit(default))


def lever_category(name: Column) -> Column:
    n = F.lower(name)
    has = lambda *ws: F.lit(False) if not ws else n.rlike("|".join(ws))
    return F.when(has("temp", "thermal", "arrhenius"), "temperature").when(has("speed", "rotor"), "rotor_speed").when(has("ram"), "ram_pressure").when(has("time", "duration"), "time").when(has("fill", "weight"), "fill_factor").otherwise("recipe")


def maturity(history: Column, bounds: Column, gates: Column) -> Column:
    return F.when(history < 5, "L0").when(history < 20, "L1").when(~bounds, "L2").when(~gates, "L3").otherwise("L4")


def context_diff(df: DataFrame, numeric: list[tuple[str, str]], categorical: list[tuple[str, str]], times: tuple[str, str] | None = None) -> DataFrame:
    """diff_<name> between current and template: absolute, 0/1 mismatch (null equals null), and age_days."""
    out = {f"diff_{a}": F.abs(F.col(a) - F.col(b)) for a, b in numeric} | {f"diff_{a}": (~F.col(a).eqNullSafe(F.col(b))).cast("int") for a, b in categorical}
    if times:
        out["age_days"] = F.datediff(F.col(times[0]), F.col(times[1]))
    return df.withColumns(out)


def top_factors(values: Mapping[str, Column], k: int = 3) -> Column:
    """Names of the k largest values in order, ties by name; null values stand last, "-" fills up."""
    cells = F.array(*[F.struct((-F.coalesce(v, F.lit(float("-inf")))).alias("v"), F.lit(n).alias("n")) for n, v in values.items()])
    names = F.transform(F.slice(F.array_sort(cells), 1, k), lambda x: x["n"])
    return F.slice(F.concat(names, F.array_repeat(F.lit("-"), k)), 1, k)


def production_date(primary: Column, fallback: Column) -> Column:
    return F.to_date(F.coalesce(F.try_to_timestamp(primary.cast("string")), F.try_to_timestamp(fallback.cast("string"))))


def apply_aliases(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Old names become new ones; where both exist the new one's nulls are filled from the old."""
    for old, new in names.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df


def json_field(column: Column, path: str) -> Column:
    return F.get_json_object(column, path)
