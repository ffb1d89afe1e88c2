"""Six change detectors over ordered scores, and their agreement.

Each takes rows of (keys, t_index, score, weight) and returns (keys, t_index) of its alerts. `position` counts the rows
of a trajectory from 0; it decides warm-up and control limits, while t_index names the alert.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators.sequence import KEY, along

UP_TO = (Window.unboundedPreceding, 0)


def positions(df: DataFrame, keys=KEY) -> DataFrame:
    """`df` with position, n (rows of the trajectory) and warmup, the number of rows that set the normal state."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumns({"position": (F.row_number().over(along(keys)) - 1).cast("long"), "n": n}).withColumn("warmup", F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.col("n") / 3))))


def crash_or_rut(df: DataFrame, low: float = -0.4, run: int = 3, weight: float = 0.15, keys=KEY) -> DataFrame:
    """A fall from 0 or more to below 0, or the `run`-th consecutive score below `low` (never counting position 0)."""
    w = along(keys)
    crash = (F.lag("score").over(w) >= 0) & (F.col("score") < 0)
    below = (F.col("score") < low) & (F.col("position") >= 1)
    marked = df.withColumns({"_crash": F.coalesce(crash, F.lit(False)), "_low": below}).withColumn("_breaks", F.sum(F.when(F.col("_low"), 0).otherwise(1)).over(w.rowsBetween(*UP_TO)))
    nth = F.sum(F.when(F.col("_low"), 1).otherwise(0)).over(Window.partitionBy(*keys, "_breaks").orderBy("t_index").rowsBetween(*UP_TO))
    marked = marked.withColumn("_rut", F.col("_low") & (nth == run))
    return marked.where((F.col("_crash") | F.col("_rut")) & (F.col("weight") >= weight)).select(*keys, "t_index")


def ema(df: DataFrame, alpha: float = 0.3, above: float = 0.10, keys=KEY) -> DataFrame:
    """Exponential mean of weight * max(0, -score), from 0, above a limit.

    Each row folds the rows before it as far back as a double can tell, so work is linear however long a trajectory is.
    """
    reach = math.ceil(math.log(1e-16) / math.log(1 - alpha))
    shortfall = F.col("weight") * F.greatest(F.lit(0.0), -F.col("score"))
    recent = F.collect_list(shortfall).over(along(keys).rowsBetween(-reach, 0))
    level = F.aggregate(recent, F.lit(0.0), lambda acc, s: acc * (1 - alpha) + s * alpha)
    return df.withColumn("level", level).where(F.col("level") > above).select(*keys, "t_index")


def cusum(df: DataFrame, slack: float = 0.3, above: float = 1.5, keys=KEY) -> DataFrame:
    """One-sided cumulative sum S = max(0, S + shortfall - slack), above a limit: the running sum less its least value so far."""
    w = along(keys).rowsBetween(*UP_TO)
    shortfall = F.col("weight") * F.greatest(F.lit(0.0), -F.col("score"))
    rows = df.withColumn("_c", F.sum(shortfall - slack).over(w))
    return rows.withColumn("level", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).where(F.col("level") > above).select(*keys, "t_index")


def cosine(profiles: DataFrame, keys=("persona_id",), below: float = 0.0) -> DataFrame:
    """Entries (one row per dimension) whose scores point away from the weights: their cosine is below a limit; 0 if a norm is tiny."""
    dot, a, b = F.sum(F.col("score") * F.col("weight")), F.sqrt(F.sum(F.col("score") * F.col("score"))), F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    out = profiles.groupBy(*keys, "t_index").agg(dot.alias("_dot"), a.alias("_a"), b.alias("_b"))
    value = F.when((F.col("_a") <= 1e-8) | (F.col("_b") <= 1e-8), 0.0).otherwise(F.try_divide(F.col("_dot"), F.col("_a") * F.col("_b")))
    return out.withColumn("cosine", value).where(F.col("cosine") < below).select(*keys, "t_index", "cosine")


def control_chart(df: DataFrame, width: float = 2.0, keys=KEY, tolerance: float = 1e-9) -> DataFrame:
    """Scores below mean - width * deviation (population) of the warm-up rows, after the warm-up; one within `tolerance` of
    that limit is on it, whichever way its last digits were rounded."""
    every = Window.partitionBy(*keys)
    early = F.when(F.col("position") < F.col("warmup"), F.col("score"))
    rows = df.withColumns({"_mean": F.avg(early).over(every), "_sd": F.stddev_pop(early).over(every)})
    return rows.where((F.col("position") >= F.col("warmup")) & (F.col("score") < F.col("_mean") - width * F.col("_sd") - tolerance)).select(*keys, "t_index")


def kl_divergence(df: DataFrame, above: float = 0.15, smoothing: float = 0.05, recent: int = 3, keys=KEY) -> DataFrame:
    """Divergence in nats of the last `recent` scores' distribution (below, at, above 0) from the warm-up's, from warm-up + recent on."""
    w, every = along(keys).rowsBetween(1 - recent, 0), Window.partitionBy(*keys)
    bins = {"n": F.col("score") < -0.5, "z": F.col("score").between(-0.5, 0.5), "p": F.col("score") > 0.5}
    hit = lambda c: F.when(c, 1.0).otherwise(0.0)
    now = {f"_now_{k}": F.sum(hit(c)).over(w) + smoothing for k, c in bins.items()}
    base = {f"_base_{k}": F.sum(hit(c & (F.col("position") < F.col("warmup")))).over(every) + smoothing for k, c in bins.items()}
    rows = df.withColumns(now | base)
    total = lambda kind: F.col(f"_{kind}_n") + F.col(f"_{kind}_z") + F.col(f"_{kind}_p")
    share = lambda kind, k: F.col(f"_{kind}_{k}") / total(kind)
    level = reduce(lambda a, b: a + b, (share("now", k) * F.ln(share("now", k) / share("base", k)) for k in bins))
    return rows.withColumn("level", level).where((F.col("position") >= F.col("warmup") + recent) & (F.col("level") > above)).select(*keys, "t_index")


def votes(alerts: dict[str, DataFrame], keys=KEY, strong: int = 4, weak: int = 2) -> DataFrame:
    """How many detectors alert at each entry, and the band that this gives."""
    union = reduce(DataFrame.unionByName, (df.select(*keys, "t_index", F.lit(name).alias("detector")) for name, df in alerts.items()))
    counted = union.groupBy(*keys, "t_index").agg(F.count_distinct("detector").alias("n_detectors"))
    return counted.withColumn("band", F.when(F.col("n_detectors") >= strong, "strong").when(F.col("n_detectors") >= weak, "weak").otherwise("single"))


def score_alerts(df: DataFrame, alerts: DataFrame, truth: Column, keys=KEY) -> DataFrame:
    """Hits, false alerts, misses and quiet entries of a detector against a flag, in one pass after one join."""
    joined = df.select(*keys, "t_index", F.coalesce(truth, F.lit(False)).alias("_truth")).join(alerts.select(*keys, "t_index").distinct().withColumn("_alert", F.lit(True)), [*keys, "t_index"], "left")
    alert, real = F.coalesce(F.col("_alert"), F.lit(False)), F.col("_truth")
    counts = joined.agg(F.count_if(alert & real).alias("hits"), F.count_if(alert & ~real).alias("false_alerts"), F.count_if(~alert & real).alias("misses"), F.count_if(~alert & ~real).alias("quiet"))
    return counts.withColumns({
        "precision": F.try_divide(F.col("hits"), F.col("hits") + F.col("false_alerts")), "recall": F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")),
        "false_alert_rate": F.try_divide(F.col("false_alerts"), F.col("false_alerts") + F.col("quiet"))})
