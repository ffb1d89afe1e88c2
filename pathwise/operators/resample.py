"""Bootstrap and permutation over clusters, and searches over small grids. Draws come from hashes, so reruns agree."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 52 bits of the MD5 of their texts with '|' between, which
    any engine can repeat."""
    text = F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def poisson_steps(most: int = 9) -> list[float]:
    """The chances of at most 0, 1, ... most - 1 draws, Poisson with mean one."""
    acc = term = math.exp(-1.0)
    steps = [acc]
    for k in range(1, most):
        term /= k
        acc += term
        steps.append(acc)
    return steps


def poisson_weight(u: Column, most: int = 9) -> Column:
    """Number of draws in a bootstrap of many clusters: Poisson with mean one, by inversion."""
    steps = poisson_steps(most)
    out = F.when(u < steps[0], 0)
    for k, step in enumerate(steps[1:], 1):
        out = out.when(u < step, k)
    return out.otherwise(most)


def _draws(cluster, replicates: int, seed: int) -> np.ndarray:
    """What `uniform` gives for seed, every replicate and the cluster."""
    tail = "" if cluster is None else f"|{cluster}"
    return np.array([int(hashlib.md5(f"{seed}|{k}{tail}".encode()).hexdigest()[:13], 16) for k in range(replicates)]) / float(1 << 52)


def cluster_bootstrap(clusters: DataFrame, cluster: str, top: str, bottom: str, replicates: int, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Per replicate the ratio of the weighted sums of `top` and `bottom` over clusters drawn with replacement.

    `clusters` has one row per cluster (and group): the draw is a weight per cluster and replicate. Every task keeps one
    vector of sums over the replicates for each group, and only these meet: no row is made for a cluster and replicate.
    """
    steps = np.array(poisson_steps())
    kinds = {c: clusters.schema[c].dataType.simpleString() for c in by}
    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "tops array<double>", "bottoms array<double>"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for name, rows in pdf.groupby("_cluster", dropna=False, sort=False):
                weight = np.searchsorted(steps, _draws(None if pd.isna(name) else name, replicates, seed), "right").astype(float)
                for *group, _, a, b in rows.itertuples(index=False, name=None):
                    own = held.setdefault(tuple(group), np.zeros((2, replicates)))
                    own[0] += weight * (0.0 if pd.isna(a) else a)
                    own[1] += weight * (0.0 if pd.isna(b) else b)
        if held:
            yield pd.DataFrame([(*group, own[0], own[1]) for group, own in held.items()], columns=[*by, "tops", "bottoms"])

    rows = clusters.select(*by, F.col(cluster).cast("string").alias("_cluster"), F.col(top).cast("double").alias("_top"), F.col(bottom).cast("double").alias("_bottom"))
    each = rows.mapInPandas(sums, schema).select(*by, F.posexplode(F.arrays_zip("tops", "bottoms")).alias("replicate", "x"))
    return each.groupBy(*by, "replicate").agg(F.try_divide(F.sum("x.tops"), F.sum("x.bottoms")).alias("value"))


def percentile_interval(replicates: DataFrame, by: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return replicates.groupBy(*by).agg(F.percentile("value", F.lit(tail)).alias("low"), F.median("value").alias("mid"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.count("value").alias("n_replicates"))


def bca_bounds(values: list[float], estimate: float, squares: float, cubes: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of a replicate list; plain percentiles where a correction is not defined.
    squares and cubes: the sums of what the leave-one-out values lack of their mean, to the second and third power."""
    xs = sorted(v for v in values if v is not None and math.isfinite(v))
    if not xs:
        return math.nan, math.nan

    def at(q: float) -> float:
        x = q * (len(xs) - 1)
        i = min(int(x), len(xs) - 1)
        return xs[i] + (x - i) * (xs[min(i + 1, len(xs) - 1)] - xs[i])

    tail, normal = (1 - level) / 2, NormalDist()
    below = sum(v < estimate for v in xs) / len(xs)
    if not 0 < below < 1 or not squares > 0:
        return at(tail), at(1 - tail)
    z0, a = normal.inv_cdf(below), cubes / (6 * squares**1.5)

    def corrected(q: float) -> float:
        z = z0 + normal.inv_cdf(q)
        return normal.cdf(z0 + z / (1 - a * z))

    return at(corrected(tail)), at(corrected(1 - tail))


def bca_interval(clusters: DataFrame, cluster: str, top: str, bottom: str, replicates: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: estimate and BCa bounds of a ratio. Each cluster is left out once: its value is the totals less its own sums,
    and two aggregations give the mean and the powers. The driver sees the replicates, never the clusters."""
    spark = clusters.sparkSession
    total = clusters.agg(F.sum(top).alias("t"), F.sum(bottom).alias("b")).first()
    estimate = float(total["t"]) / float(total["b"]) if total["b"] else math.nan
    left_out = clusters.select(F.try_divide(F.lit(total["t"]).cast("double") - F.col(top), F.lit(total["b"]).cast("double") - F.col(bottom)).alias("j"))
    lacks = F.lit(left_out.agg(F.avg("j")).first()[0]) - F.col("j")
    squares, cubes = (x or 0.0 for x in left_out.agg(F.sum(F.pow(lacks, 2)), F.sum(F.pow(lacks, 3))).first())
    values = [r["value"] for r in cluster_bootstrap(clusters, cluster, top, bottom, replicates, seed).collect()]
    low, high = bca_bounds(values, estimate, squares, cubes, level)
    return spark.createDataFrame([(estimate, low, high, replicates)], "estimate double, low double, high double, n_replicates int")


def permutation_test(clusters: DataFrame, cluster: str, stratum: str, x: str, y: str, replicates: int, seed: int = 7) -> DataFrame:
    """One row: |sum x*y| against that with y permuted within strata, p = (1 + as extreme) / (replicates + 1).

    In each replicate the k-th cluster of a stratum by one hash order takes the y of the k-th by another.
    """
    draws = clusters.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = lambda salt: Window.partitionBy("replicate", stratum).orderBy(uniform(F.lit(salt), F.col("replicate"), F.col(cluster)), cluster)
    left = draws.select("replicate", stratum, x, F.row_number().over(Window.partitionBy("replicate", stratum).orderBy(cluster)).alias("k"))
    right = draws.select("replicate", stratum, y, F.row_number().over(order(seed)).alias("k"))
    shuffled = left.join(right, ["replicate", stratum, "k"]).groupBy("replicate").agg(F.sum(F.col(x) * F.col(y)).alias("s"))
    seen = clusters.agg(F.sum(F.col(x) * F.col(y)).alias("observed"))
    counts = shuffled.crossJoin(F.broadcast(seen)).groupBy("observed").agg(F.count_if(F.abs("s") >= F.abs("observed")).alias("extreme"), F.count(F.lit(1)).alias("n"))  # `seen` is one row
    return counts.select("observed", ((1 + F.col("extreme")) / (F.col("n") + 1)).alias("p"), F.col("n").alias("n_replicates"))


def placement_test(opportunities: DataFrame, triggers: DataFrame, references: DataFrame, week: list[str], replicates: int, seed: int = 7) -> DataFrame:
    """One row: whether triggers meet references more often than as many opportunities placed at random.

    opportunities and triggers: week (columns that name it) and cutoff; references: week and confirmation. A placement hits
    if a reference of its week is confirmed by its cutoff. In each replicate as many weeks as there are triggers are drawn
    without replacement, those with the least hashes, and one opportunity of each by another hash."""
    first = references.groupBy(*week).agg(F.min("confirmation").alias("_first"))
    hit = F.coalesce(F.col("_first") <= F.col("cutoff"), F.lit(False))
    seen = triggers.join(first, week, "left").agg(F.count(F.lit(1)).alias("n_triggers"), F.count_if(hit).alias("n_hits")).first()
    chances = opportunities.join(first, week, "left").groupBy(*week).agg(F.sort_array(F.collect_list(F.struct("cutoff", hit.alias("hit")))).alias("_all"))  # a week's opportunities: a few
    n_weeks, n = chances.count(), seen["n_triggers"]
    if n > n_weeks:
        raise ValueError("more triggers than eligible weeks")
    name = F.concat_ws(":", *(F.col(c).cast("string") for c in week))
    draws = chances.select(name.alias("_name"), "_all", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = draws.withColumn("_u", uniform(F.lit(seed), F.col("replicate"), F.col("_name")))
    rank = F.row_number().over(Window.partitionBy("replicate").orderBy("_u", "_name"))
    pick = F.least(F.floor(uniform(F.lit(seed + 1), F.col("replicate"), F.col("_name")) * F.size("_all")), F.size("_all") - 1).cast("int")
    placed = draws.withColumn("_rank", rank).where(F.col("_rank") <= n).groupBy("replicate").agg(F.count_if(F.get("_all", pick)["hit"]).alias("hits"))
    rate = F.col("hits") / F.lit(n) if n else F.lit(0.0)
    observed = seen["n_hits"] / n if n else 0.0
    rates = placed.select(rate.cast("double").alias("rate"))
    out = rates.agg(F.count(F.lit(1)).alias("n_replicates"), F.avg("rate").alias("random_mean"), F.median("rate").alias("random_median"), F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"),
                    F.count_if(F.col("rate") <= observed).alias("_le"), F.count_if(F.col("rate") >= observed).alias("_ge"))
    return out.select(F.lit(n_weeks).cast("long").alias("n_weeks"), F.lit(n).cast("long").alias("n_triggers"), F.lit(observed).alias("observed_rate"), "random_mean", "random_median", "low", "high",
                      (F.col("_le") / F.col("n_replicates")).alias("percentile"), ((1 + F.col("_ge")) / (F.col("n_replicates") + 1)).alias("p"), "n_replicates")


def weighted_choice(df: DataFrame, weights: dict[str, float], *seed) -> DataFrame:
    """`df` with `choice`, drawn by hash of the seed columns; weights must be finite, none negative, some positive."""
    if not weights or any(not math.isfinite(w) or w < 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be finite, none negative and some positive")
    whole, acc, u = sum(weights.values()), 0.0, uniform(*seed)
    out = None
    for name, w in weights.items():
        acc += w / whole
        out = (F if out is None else out).when(u < acc, name)
    return df.withColumn("choice", out.otherwise([n for n, w in weights.items() if w > 0][-1]))


def simplex_grid(spark, parts: int, steps: int) -> DataFrame:
    """All weights of `parts` that are multiples of 1/steps and add to one: a small driver-made grid."""
    grid: list[tuple[int, ...]] = [()]
    for _ in range(parts - 1):
        grid = [g + (k,) for g in grid for k in range(steps - sum(g) + 1)]
    return spark.createDataFrame([(i, [k / steps for k in (*g, steps - sum(g))]) for i, g in enumerate(grid)], "grid_id int, weights array<double>")
