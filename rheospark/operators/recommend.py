"""Setpoint recommendation as one candidate table: masks, draws, quality checks, gates, selection, review views."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from .joins import first_rows
from .splits import uniform


def stage_mask(df: DataFrame, durations: Mapping[str, str], route: str) -> DataFrame:
    """has_<stage>: the stage lasts, and is not an oil stage on the dry route."""
    return df.withColumns({f"has_{s}": F.coalesce(F.col(c) > 0, F.lit(False)) & ((F.col(route) == "oil") | ~F.lit(s in ("oil", "wet"))) for s, c in durations.items()})


def generate_candidates(df: DataFrame, keys: list[str], params: Mapping[str, tuple[Column, Column, Column, Column]], n: int = 25, seed: int = 42) -> DataFrame:
    """Rows (keys, candidate, params): candidate 0 is nominal, the others are uniform draws within bounds, which depend on
    the keys, the candidate and the parameter alone. params: name -> (nominal, low, high, present); absent ones are 0."""
    rows = df.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    cells = {}
    for name, (nominal, low, high, there) in params.items():
        draw = low + (high - low) * uniform(*keys, "candidate", F.lit(name), seed=seed)
        cells[name] = F.when(~there, 0.0).otherwise(half_even(F.when(F.col("candidate") == 0, nominal).otherwise(draw), 1))
    return rows.withColumns(cells)


def template_candidates(df: DataFrame, templates: DataFrame, keys: list[str], setpoints: list[str]) -> DataFrame:
    """Historical setpoints of the key's templates in the current context."""
    return df.drop(*setpoints).join(templates.select(*keys, *setpoints), keys)


def quality_check(df: DataFrame, pred: str, sigma: str, lower: str, upper: str, distance: str, conservative: str | None = None, unit: float = 1.0) -> DataFrame:
    """Interval, whether it lies in spec, risk, confidence, ood, and valid. sigma counts units of 1 / unit: whole ones make an
    exact decimal of the half width, which is divided last."""
    k = F.lit(Decimal("1.96")) if conservative is None else F.when(F.col(conservative), 1.96 * 1.2).otherwise(1.96 * 0.9)
    half = (k * F.col(sigma)).cast("double") / unit
    out = df.withColumns({"low": F.col(pred) - half, "high": F.col(pred) + half})
    inside = F.coalesce((F.col("low") >= F.col(lower)) & (F.col("high") <= F.col(upper)), F.lit(False))
    edge = F.least(F.col(pred) - F.col(lower), F.col(upper) - F.col(pred)) / F.nullif(half, F.lit(0.0))
    out = out.withColumns({"in_spec": inside, "risk": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - edge / 2)), "ood": F.coalesce(F.col(distance) > 1.2, F.lit(True))})
    out = out.withColumn("confidence", F.when(F.col("ood"), "LOW").when(F.col("risk") < 0.3, "HIGH").when(F.col("risk") < 0.6, "MEDIUM").otherwise("LOW"))
    return out.withColumn("valid", F.col("in_spec") & ~F.col("ood"))


def candidate_status(df: DataFrame, match_level: str, maturity: str) -> DataFrame:
    """status and reason, by the first rule that holds."""
    rules = [
        (F.col(match_level) == "UNAVAILABLE", "NO_BOUNDS", "no safe bounds for this recipe"),
        (F.col(maturity).isin("L0", "L1"), "COLD_START", "too little history"),
        (F.col("ood"), "OUT_OF_DOMAIN", "far from known batches"),
        (~F.col("in_spec"), "QUALITY_RISK", "interval leaves the specification"),
    ]
    status, reason = F.lit("OK"), F.lit("")
    for condition, name, text in reversed(rules):
        hit = F.coalesce(condition, F.lit(False))
        status, reason = F.when(hit, name).otherwise(status), F.when(hit, text).otherwise(reason)
    return df.withColumns({"status": status, "status_reason": reason})


def recommend(df: DataFrame, keys: list[str], energy: str, per_ton: str, actual: str, valid: str = "valid", min_valid: int = 20, min_kwh: float = 3.0, min_share: float = 0.08) -> DataFrame:
    """One row per key: the valid candidate of least energy per ton (ties by candidate), its savings against the actual and
    against the nominal candidate, decision and the first rejection reason. Candidates of a key are few; keys are many."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    best = F.min(F.when(ok, F.struct(per_ton, "candidate", energy))).alias("_b")
    nominal = F.max(F.when(F.col("candidate") == 0, F.col(energy))).alias("nominal_kwh")
    out = df.groupBy(*keys).agg(F.count("*").alias("n_candidates"), F.count_if(ok).alias("n_valid"), best, nominal, F.max(actual).alias("actual_kwh"))
    out = out.select(*keys, "n_candidates", "n_valid", "actual_kwh", "nominal_kwh", F.col("_b.candidate").alias("candidate"), F.col(f"_b.{energy}").alias("best_kwh"), F.col(f"_b.{per_ton}").alias("best_per_ton"))
    out = out.withColumns({"saving_actual": F.col("actual_kwh") - F.col("best_kwh"), "saving_model": F.col("nominal_kwh") - F.col("best_kwh")})
    share = F.col("saving_model") / F.nullif(F.col("nominal_kwh"), F.lit(0.0))
    small = ~F.coalesce((F.col("saving_model") >= min_kwh) | (share >= min_share), F.lit(False))
    reason = F.when(F.col("n_valid") == 0, "NO_VALID_CANDIDATE").when(F.col("n_valid") < min_valid, "TOO_FEW_VALID").when(F.coalesce(F.col("saving_model") <= 0, F.lit(True)), "NO_SAVING").when(small, "SAVING_TOO_SMALL").otherwise("")
    return out.withColumn("rejection_reason", reason).withColumn("decision", F.when(F.col("rejection_reason") == "", "RECOMMEND").otherwise("REJECT"))


def shadow_run(recommended: DataFrame, branch: str) -> dict[str, DataFrame]:
    """recommended, rejected, and per branch counts with the most frequent rejection reason."""
    from .aggs import mode

    accepted, rejected = recommended.where("decision = 'RECOMMEND'"), recommended.where("decision = 'REJECT'")
    summary = recommended.groupBy(branch).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "RECOMMEND").alias("n_recommended"), F.avg(F.when(F.col("decision") == "RECOMMEND", F.col("saving_model"))).alias("mean_saving"))
    top = mode(rejected, [branch], "rejection_reason", "top_rejection")
    return {"recommended": accepted, "rejected": rejected, "summary": summary.join(top, branch, "left")}


def review_views(df: DataFrame, confidence: str = "confidence", maturity: str = "maturity") -> dict[str, DataFrame]:
    good = F.col("decision") == "RECOMMEND"
    return {
        "pilot": df.where(good & (F.col(confidence) == "HIGH") & F.col(maturity).isin("L3", "L4")),
        "observe": df.where(good & (F.col(confidence) == "MEDIUM")),
        "cold_start": df.where(F.col(maturity).isin("L0", "L1")),
        "preliminary": df.where(good & (F.col(maturity) == "L2")),
    }


def tradeoff(df: DataFrame, keys: list[str], energy: str, deviation: str, k: int = 5) -> DataFrame:
    """Of each key the k valid candidates of least energy, with their quality deviation."""
    return first_rows(df.where("valid"), keys, [F.col(energy), F.col(deviation), F.col("candidate")], k)
