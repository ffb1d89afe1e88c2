"""Weekly frames: tumbling Monday weeks, digests, the evolution filter and the router."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.functions.scalars import expected_alignment, week_start


def aggregate_weeks(df: DataFrame, values: list[str], keys=("persona_id",), day: str = "d", count: str = "n_entries") -> DataFrame:
    """One row per key and Monday week: entries and the mean of each value, with the week's bounds."""
    weekly = df.groupBy(*keys, week_start(day).alias("week_start")).agg(F.count(F.lit(1)).alias(count), *(F.avg(v).alias(v) for v in values))
    return weekly.withColumn("week_end", F.date_add("week_start", 6))


def digest(df: DataFrame, keys=("persona_id", "dimension"), score: str = "score", day: str = "d") -> DataFrame:
    """Mean and shares of -1, 0 and 1 per key and week."""
    s = F.col(score)
    share = lambda v: F.avg(F.when(s.isNotNull(), (s == v).cast("double")))
    return df.groupBy(*keys, week_start(day).alias("week_start")).agg(F.avg(s).alias("mean_score"), share(-1).alias("pct_neg"), share(0).alias("pct_neutral"), share(1).alias("pct_pos"))


def rank_dimensions(means: DataFrame, direction: str, limit: int, keys=("persona_id", "week_start"), value: str = "mean_score") -> DataFrame:
    """Dimensions below 0 ('tension', lowest first) or above ('strength', highest first): declared ones, then others."""
    sign, order = {"tension": (F.col(value) < 0, F.col(value).asc()), "strength": (F.col(value) > 0, F.col(value).desc())}[direction]
    w = Window.partitionBy(*keys).orderBy(F.col("is_core").desc(), order, "dim_index")
    return means.where(sign).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def evolution(weekly: DataFrame, lookback: int = 6, least: int = 3, residual: float = 0.4, volatility: float = 0.5, floor: float = 0.15) -> DataFrame:
    """Each dimension over its last `lookback` weeks: stable, evolution (a steady residual) or drift (a volatile one).

    Rows: persona_id, dimension, week_start, alignment, weight. The weight is that of the first of these weeks.
    """
    key = ("persona_id", "dimension")
    recent = weekly.withColumn("_back", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("week_start")))).where(F.col("_back") <= lookback)
    out = recent.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_weeks"), F.min_by("weight", "week_start").alias("weight"), F.avg("alignment").alias("mean_alignment"), F.stddev_pop("alignment").alias("volatility"), F.max("week_start").alias("week_start"))
    out = out.withColumn("residual", F.col("mean_alignment") - expected_alignment("weight", floor))
    kind = F.when((F.col("n_weeks") < least) | (F.abs("residual") < residual), "stable").when(F.col("volatility") < volatility, "evolution").otherwise("drift")
    way = F.when(F.col("mean_alignment") > 1e-6, "up").when(F.col("mean_alignment") < -1e-6, "down").otherwise("flat")
    return out.withColumns({"classification": kind, "direction": way})


def profile_suggestion(dimensions: DataFrame, blend: float = 0.3) -> DataFrame:
    """Weights of personas with an evolved dimension, blended with what they show: (mean + 1) / 2 there, all normalized twice."""
    p = Window.partitionBy("persona_id")
    evolved = F.col("classification") == "evolution"
    rows = dimensions.withColumns({"_any": F.max(evolved).over(p), "_shown": F.when(evolved, (F.col("mean_alignment") + 1) / 2).otherwise(F.col("weight"))}).where("_any")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(p))
    share = lambda c: F.when(F.sum(c).over(p) > 0, F.try_divide(F.col(c), F.sum(c).over(p))).otherwise(1.0 / F.col("_n"))
    rows = rows.withColumn("_blended", (1 - blend) * F.col("weight") + blend * share("_shown"))
    return rows.select("persona_id", "dimension", "weight", share("_blended").alias("suggested"))


def route(weekly: DataFrame, rut: int = 3, rut_below: float = -0.4, crash: float = 0.5, uncertain: float = 0.3, weight: float = 0.15, **evolution_args) -> DataFrame:
    """One mode per persona for its last week: high_uncertainty, crash, rut, evolution or stable, with the dimensions that set it.

    Rows: persona_id, week_start, dimension, dim_index, alignment, uncertainty, weight, overall_mean, overall_uncertainty.
    """
    key = ("persona_id", "dimension")
    w = Window.partitionBy(*key).orderBy("week_start")
    last = w.rowsBetween(1 - rut, 0)
    rows = weekly.withColumns({
        "_fall": F.lag("alignment").over(w) - F.col("alignment"), "_scalar_fall": F.lag("overall_mean").over(w) - F.col("overall_mean"), "_n": F.count(F.lit(1)).over(last),
        "_high": F.max("alignment").over(last), "_unsure": F.max("uncertainty").over(last), "_back": F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("week_start")))}).where("_back = 1")
    kinds = evolution(weekly, least=max(rut, 3), **evolution_args).select(*key, "classification", F.col("weight").alias("_first_weight"))
    rows = rows.join(kinds, list(key))
    rows = rows.withColumn("_evolution", (F.col("classification") == "evolution") & (F.col("_first_weight") >= weight))
    counts = (F.col("weight") >= weight) & ~F.col("_evolution")
    no = F.lit(False)
    rows = rows.withColumns({
        "_rut": F.coalesce(counts & (F.col("_n") == rut) & (F.col("_high") < rut_below) & (F.col("_unsure") < uncertain), no),
        "_crash": F.coalesce(counts & (F.col("_scalar_fall") > crash) & (F.col("_fall") > 0), no), "_vague": F.col("uncertainty") >= uncertain})
    named = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("dimension"))))
    strongest = F.slice(F.transform(F.sort_array(F.collect_list(F.struct(F.abs("alignment").alias("a"), F.col("weight").alias("w"), (-F.col("dim_index")).alias("i"), F.col("dimension").alias("dimension"))), asc=False), lambda x: x["dimension"]), 1, 2)
    out = rows.groupBy("persona_id").agg(
        F.max("week_start").alias("week_start"), F.max("overall_mean").alias("overall_mean"), F.max("overall_uncertainty").alias("overall_uncertainty"),
        named("_vague").alias("_v"), named("_crash").alias("_c"), named("_rut").alias("_r"), named("_evolution").alias("_e"), strongest.alias("_s"))
    some = lambda c: F.size(c) > 0
    mode = F.when(F.col("overall_uncertainty") >= uncertain, "high_uncertainty").when(some("_c"), "crash").when(some("_r"), "rut").when(some("_e"), "evolution").otherwise("stable")
    out = out.withColumn("mode", mode)
    named_by = F.when(F.col("mode") == "high_uncertainty", F.col("_v")).when(F.col("mode") == "crash", F.col("_c")).when(F.col("mode") == "rut", F.col("_r")).when(F.col("mode") == "evolution", F.col("_e")).otherwise(F.col("_s"))
    return out.select("persona_id", "week_start", "mode", named_by.alias("dimensions"))


def week_state_reason(decisions: DataFrame, before: DataFrame, keys=("persona_id", "dimension")) -> DataFrame:
    """Why an active state ended: the first row after `last_t` that skips a number, abstains or clears; null if none does.

    `before` has last_t per key whose state was active.
    """
    w = Window.partitionBy(*keys).orderBy("t_index")
    rows = decisions.join(before.select(*keys, "last_t"), list(keys)).where(F.col("t_index") > F.col("last_t"))
    gap = F.col("t_index") != F.coalesce(F.lag("t_index").over(w), F.col("last_t")) + 1
    reason = F.when(gap, "gap").when((F.col("review_status") != "ok") | (F.col("verdict") == "abstain"), "abstain").when(F.col("verdict") == "not_conflict", "not_conflict")
    return rows.withColumn("reason", reason).groupBy(*keys).agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("t_index"))).alias("end_reason"))


