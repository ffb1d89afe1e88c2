"""Agreement and accuracy of label pairs, as plain aggregates. A measure that is not defined is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators.relational import running_sum
from pathwise.session import checkpointed


def _sums(a: str, b: str) -> tuple[Column, ...]:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1.0))
    return F.sum(both), F.sum(both * x), F.sum(both * y), F.sum(both * x * x), F.sum(both * y * y), F.sum(both * x * y)


def pearson(a: str, b: str) -> Column:
    """Correlation by sums; null where a side does not vary."""
    return _correlation(*_sums(a, b))


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    vx, vy = n * xx - x * x, n * yy - y * y
    return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(n * xy - x * y, F.sqrt(vx) * F.sqrt(vy)))


def quadratic_kappa(a: str, b: str) -> Column:
    """Quadratic weighted kappa of integer labels; null where a side does not vary."""
    n, x, y, xx, yy, xy = _sums(a, b)
    varies = (n * xx - x * x > 0) & (n * yy - y * y > 0)
    return F.when(varies, 1 - F.try_divide(n * (xx + yy - 2 * xy), n * xx + n * yy - 2 * x * y))


def cohen_kappa(a: str, b: str, labels=(-1, 0, 1)) -> Column:
    """Unweighted kappa; null where chance agreement is complete."""
    x, y = F.col(a), F.col(b)
    n = F.count_if(x.isNotNull() & y.isNotNull()).cast("double")
    observed = F.try_divide(F.count_if(x == y), n)
    chance = sum((F.count_if((x == k) & y.isNotNull()) * F.count_if((y == k) & x.isNotNull()).cast("double") for k in labels), F.lit(0.0))
    expected = F.try_divide(chance, n * n)
    return F.try_divide(observed - expected, 1 - expected)


def error_measures(prediction: str, target: str) -> dict[str, Column]:
    p, t = F.col(prediction), F.col(target)
    return {"mse": F.avg((p - t) * (p - t)), "mae": F.avg(F.abs(p - t)), "hedging": F.avg((F.abs(p) < 0.3).cast("double"))}


def recall_of(target: str, predicted: str, k: int) -> Column:
    t, p = F.col(target), F.col(predicted)
    return F.try_divide(F.count_if((t == k) & (p == k)), F.count_if((t == k) & p.isNotNull()))


def binary_measures(target: Column, predicted: Column) -> dict[str, Column]:
    """Counts and ratios of booleans; a null prediction abstains and counts as a miss."""
    tp, fp, fn = F.count_if(target & predicted), F.count_if(~target & predicted), F.count_if(target & ~F.coalesce(predicted, F.lit(False)))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "n_abstained": F.count_if(predicted.isNull()), "precision": precision, "recall": recall, "f1": F.try_divide(2 * tp, 2 * tp + fp + fn)}


def _mean_ranks(counts: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """by, column and the mean rank of a value's copies in its group, from counts `_n` of distinct values. The counts are
    summed over ranges, so that no task holds a group."""
    upto = running_sum(counts.withColumn("_at", F.struct(*by, column)), "_at", "_n").withColumn("_before", F.col("upto") - F.col("_n"))
    starts = upto.groupBy(*by).agg(F.min("_before").alias("_start"))
    same = reduce(lambda a, b: a & b, (F.col(f"u.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by), F.lit(True))
    rank = F.col("_before") - F.col("_start") + (F.col("_n") + 1) / 2.0
    return upto.alias("u").join(starts.alias("s"), same).select(*(f"u.{k}" for k in (*by, column)), rank.cast("double").alias(name))


def spearman(df: DataFrame, by: list[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Correlation of mean ranks, from counts of each pair of values."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_pairs"))
    kept = checkpointed(pairs)
    each = kept.select(*by, a, b, F.col("_pairs").cast("double"))
    for column, rank in ((a, "_ra"), (b, "_rb")):
        counts = kept.groupBy(*by, column).agg(F.sum("_pairs").alias("_n"))
        ranks = _mean_ranks(counts, by, column, rank)
        same = reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*by, column)))
        each = each.alias("l").join(ranks.alias("r"), same).select("l.*", rank)
    w, x, y = F.col("_pairs"), F.col("_ra"), F.col("_rb")
    return each.groupBy(*by).agg(_correlation(*map(F.sum, (w, w * x, w * y, w * x * x, w * y * y, w * x * y))).alias(name))


def fleiss_kappa(df: DataFrame, by: list[str], item: str, score: str = "score", labels=(-1, 0, 1)) -> DataFrame:
    """Fleiss' kappa per group over items that all have the same number of raters."""
    counts = [f"_n{k}" for k in range(len(labels))]
    items = df.groupBy(*by, item).agg(*(F.count_if(F.col(score) == k).cast("double").alias(c) for k, c in zip(labels, counts, strict=True)), F.count(score).cast("double").alias("_n"))
    within = sum((F.col(c) * (F.col(c) - 1) for c in counts), F.lit(0.0))
    out = items.groupBy(*by).agg(
        F.avg(F.try_divide(within, F.col("_n") * (F.col("_n") - 1))).alias("_p"), F.count(F.lit(1)).alias("n_items"), *(F.try_divide(F.sum(c), F.sum("_n")).alias(c) for c in counts))
    chance = sum((F.col(c) * F.col(c) for c in counts), F.lit(0.0))
    return out.select(*by, "n_items", F.try_divide(F.col("_p") - chance, 1 - chance).alias("kappa"))


def calibration_quality(rho: Column) -> Column:
    return F.when(rho.isNull(), "unknown").when(rho >= 0.3, "good").when(rho >= 0.1, "marginal").when(rho >= 0.0, "poor").otherwise("negative")


def proper_scores(p: str, target: str) -> dict[str, Column]:
    """Negative log likelihood and Brier score of distributions against distributions (arrays of three)."""
    nll = -F.aggregate(F.zip_with(F.col(p), F.col(target), lambda a, b: b * F.ln(F.greatest(a, F.lit(1e-12)))), F.lit(0.0), lambda s, x: s + x)
    brier = F.aggregate(F.zip_with(F.col(p), F.col(target), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return {"nll": F.avg(nll), "brier": F.avg(brier)}


#: Neighbours and opposites among the ten values.
ADJACENT = (
    ("achievement", "hedonism"), ("achievement", "power"), ("benevolence", "conformity"), ("benevolence", "tradition"), ("benevolence", "universalism"), ("conformity", "security"),
    ("conformity", "tradition"), ("hedonism", "stimulation"), ("power", "security"), ("security", "tradition"), ("self_direction", "stimulation"), ("self_direction", "universalism"),
)
OPPOSITE = (
    ("achievement", "benevolence"), ("achievement", "universalism"), ("benevolence", "power"), ("conformity", "hedonism"), ("conformity", "self_direction"), ("conformity", "stimulation"),
    ("hedonism", "tradition"), ("power", "universalism"), ("security", "self_direction"), ("security", "stimulation"), ("self_direction", "tradition"), ("stimulation", "tradition"),
)


def circumplex(rows: DataFrame, item: str, score: str | None = None, plus: str | None = None, minus: str | None = None, dimension: str = "dimension") -> DataFrame:
    """relation, left, right, score and mean of the relation's scores, for 12 adjacent and 12 opposite pairs.

    By expected scores: adjacent pairs score the mean product of what both have above 0, opposite ones that of the product
    where it is above 0. By probabilities (plus, minus): both plus, and for opposite pairs both minus, too. Items without a
    value in every dimension are left out; an item's ten rows meet in one aggregation, and one more gives all pairs."""
    dims = sorted({d for pair in ADJACENT + OPPOSITE for d in pair})
    columns = {"s": score} if score else {"p": plus, "m": minus}
    cell = lambda k, c, d: F.max(F.when(F.col(dimension) == d, F.col(c))).alias(f"{k}_{d}")
    items = rows.groupBy(item).agg(*(cell(k, c, d) for k, c in columns.items() for d in dims)).na.drop()
    both = lambda k, a, b: F.col(f"{k}_{a}") * F.col(f"{k}_{b}")
    above = lambda c: F.greatest(c, F.lit(0.0))

    def value(relation: str, a: str, b: str) -> Column:
        if score:
            return above(F.col(f"s_{a}").cast("double")) * above(F.col(f"s_{b}").cast("double")) if relation == "adjacent" else above(both("s", a, b).cast("double"))
        return both("p", a, b) if relation == "adjacent" else both("p", a, b) + both("m", a, b)

    pairs = [(relation, a, b) for relation, some in (("adjacent", ADJACENT), ("opposite", OPPOSITE)) for a, b in some]
    means = items.agg(*(F.avg(value(*pair)).alias(f"x{k}") for k, pair in enumerate(pairs)))  # one row
    out = means.select(F.inline(F.array(*(F.struct(F.lit(r).alias("relation"), F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"x{k}").alias("score")) for k, (r, a, b) in enumerate(pairs)))))
    return out.withColumn("mean", F.avg("score").over(Window.partitionBy("relation")))  # 12 rows each


def policy_bundle(rows: DataFrame, by: list[str], target: str = "target", prediction: str = "prediction", predicted: str = "predicted", uncertainty: str = "uncertainty") -> DataFrame:
    """by, and per group n, mse, mae, accuracy, qwk, the three recalls and their minority mean, hedging, calibration (rank
    correlation of uncertainty and error) with its band, activation precision and recall, and sign accuracy on active rows:
    one aggregation, and one for the ranks."""
    t, p = F.col(target), F.col(predicted)
    e = error_measures(prediction, target)
    recalls = {f"recall_{name}": recall_of(target, predicted, k) for name, k in (("minus", -1), ("zero", 0), ("plus", 1))}
    active = binary_measures(t != 0, p != 0)
    plain = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), e["mse"].alias("mse"), e["mae"].alias("mae"), F.avg((t == p).cast("double")).alias("accuracy"), quadratic_kappa(target, predicted).alias("qwk"), *(c.alias(k) for k, c in recalls.items()),
        ((recalls["recall_minus"] + recalls["recall_plus"]) / 2).alias("minority_recall"), e["hedging"].alias("hedging"), active["precision"].alias("activation_precision"), active["recall"].alias("activation_recall"),
        F.try_divide(F.count_if((t != 0) & (t == p)), F.count_if((t != 0) & (p != 0))).alias("sign_accuracy"))
    error = rows.withColumn("_error", F.round(F.abs(F.col(prediction) - t), 9))
    rho = spearman(error, by, uncertainty, "_error", "calibration")
    return plain.join(rho, by, "left").withColumn("calibration_band", calibration_quality(F.col("calibration")))
