"""Ordered trajectories: runs, gaps, pairs, episodes and the change detectors, as window functions.

A trajectory is one key (say persona_id, dimension) ordered by t_index. All functions partition by the key that they are
given, so operators over one key share one exchange. A null label is a third state: it never equals a flag and breaks runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

KEY = ("persona_id", "dimension")


def along(keys, order: str = "t_index") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _frame(keys, order: str, start: int, end: int) -> WindowSpec:
    return along(keys, order).rowsBetween(start, end)


def flagged_runs(df: DataFrame, flag: Column, keys=KEY, order: str = "t_index", by_position: bool = False) -> DataFrame:
    """Rows where `flag` is true, with `run`, equal within an unbroken run.

    A run breaks where `flag` is false or null and, unless `by_position`, where `order` skips a number.
    """
    rank = F.row_number().over(along(keys, order))
    if by_position:
        df, at = df.withColumn("_position", rank.cast("long")), F.col("_position")
    else:
        at = F.col(order)
    return df.where(flag).withColumn("run", at - rank).drop("_position")


def drift_spans(df: DataFrame, flag: Column, keys=KEY, order: str = "t_index", least: int = 2) -> DataFrame:
    """One row per run of at least `least` consecutive flagged entries: onset, confirmation (the second), end, length."""
    runs = flagged_runs(df, flag, keys, order)
    return runs.groupBy(*keys, "run").agg(F.min(order).alias("onset"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).select(
        *keys, "onset", (F.col("onset") + 1).alias("confirmation"), "end", "length")


def longest_run(df: DataFrame, flag: Column, keys=KEY, order: str = "t_index") -> DataFrame:
    """Longest run of flagged rows by position per key; 0 where none is flagged."""
    position = F.row_number().over(along(keys, order))
    nth = F.sum(F.when(flag, 1).otherwise(0)).over(along(keys, order))
    marked = df.select(*keys, F.when(flag, 1).otherwise(0).alias("_hit"), (position - nth).alias("_island"))
    return marked.groupBy(*keys, "_island").agg(F.sum("_hit").alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))


def adjacent_pairs(df: DataFrame, keys=KEY, order: str = "t_index", columns=("label",)) -> DataFrame:
    """Every row whose successor in the trajectory has the next number, with the successor's columns as next_*."""
    w = along(keys, order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in (order, *columns)}).where(F.col(f"next_{order}") == F.col(order) + 1)


def detection_decisions(evidence: DataFrame, probability: float, uncertainty: float | None, keys=("source", *KEY)) -> DataFrame:
    """Each adjacent pair of entries: mean probability, largest uncertainty, whether it alerts (gates inclusive), else why not."""
    p, q, u, v = (F.col(c) for c in ("p_minus1", "next_p_minus1", "uncertainty", "next_uncertainty"))
    pairs = adjacent_pairs(evidence, keys, columns=("p_minus1", "uncertainty")).select(
        *keys, F.col("t_index").alias("window_start"), F.col("next_t_index").alias("window_end"),
        ((p + q) / 2).alias("mean_probability"), F.when(u.isNotNull() & v.isNotNull(), F.greatest(u, v)).alias("max_uncertainty"))
    why = F.when(F.col("mean_probability").isNull(), "missing_probability").when(F.col("mean_probability") < probability, "low_probability")
    if uncertainty is not None:
        why = why.when(F.col("max_uncertainty").isNull(), "missing_uncertainty").when(F.col("max_uncertainty") > uncertainty, "high_uncertainty")
    return pairs.withColumn("reason", why.otherwise("alert")).withColumn("alert", F.col("reason") == "alert")


def coverage(df: DataFrame, label: str = "label", keys=KEY) -> DataFrame:
    """Whether each trajectory is covered: two adjacent trues, or pairs of which each holds a false."""
    w = along(keys)
    adjacent = F.lead("t_index").over(w) == F.col("t_index") + 1
    a, b = F.col("_a"), F.col("_b")
    pairs = df.select(*keys, F.col(label).alias("_a"), F.when(adjacent, F.lead(label).over(w)).alias("_b"), F.coalesce(adjacent, F.lit(False)).alias("_pair"))
    both, some_false = F.coalesce(a & b, F.lit(False)), F.coalesce(~a, F.lit(False)) | F.coalesce(~b, F.lit(False))
    return pairs.groupBy(*keys).agg(
        F.bool_or(F.col("_pair") & both).alias("_any"), F.coalesce(F.bool_and(F.when(F.col("_pair"), some_false)), F.lit(False)).alias("_all")
    ).select(*keys, (F.col("_any") | F.col("_all")).alias("covered"))


def reference_episodes(labels: DataFrame, keys=KEY, source: str = "label") -> DataFrame:
    """Episodes of two or more adjacent -1 labels, with how the next row of the trajectory ends them."""
    w = along(keys)
    rows = labels.withColumns({"_next_t": F.lead("t_index").over(w), "_next_score": F.lead("score").over(w), "_next_tier": F.lead("confidence").over(w)})
    runs = flagged_runs(rows, F.col("score") == -1, keys)
    last = lambda c: F.max_by(c, "t_index")
    out = runs.groupBy(*keys, "run").agg(
        F.min("t_index").alias("onset_t_index"), F.max("t_index").alias("end_t_index"), F.min("d").alias("onset_date"), F.max("d").alias("end_date"),
        F.count(F.lit(1)).alias("length"), last("_next_t").alias("termination_t_index"), last("_next_score").alias("termination_label"), last("_next_tier").alias("_tier"),
        F.concat_ws(",", F.sort_array(F.collect_list("t_index")).cast("array<string>")).alias("supporting"), F.avg("agreement").alias("mean_agreement"),
    ).where("length >= 2")
    follows = F.col("termination_t_index")
    state = F.when(follows.isNull(), "active").when(
        (follows != F.col("end_t_index") + 1) | F.col("termination_label").isNull() | (F.col("_tier") == "no_majority"), "uncertain").otherwise("recovered")
    return out.select(
        F.concat_ws("::", F.lit(source), *(F.col(k).cast("string") for k in keys), F.col("onset_t_index").cast("string")).alias("episode_id"), *keys, "onset_t_index",
        (F.col("onset_t_index") + 1).alias("confirmation_t_index"), "end_t_index", "onset_date", "end_date", "length", follows.isNull().alias("open_at_cutoff"),
        state.alias("delivery_state"), "termination_t_index", "termination_label", "supporting", "mean_agreement")


def predicted_episodes(evidence: DataFrame, probability: float, uncertainty: float | None, keys=("source", *KEY)) -> DataFrame:
    """Chains of alerting pairs that share an entry; the entry numbered end + 1 tells whether the episode goes on."""
    w = along(keys)
    rows = evidence.withColumns({f"_{c}": F.lead(c).over(w) for c in ("t_index", "p_minus1", "uncertainty", "predicted_class")})
    rows = rows.withColumn("_adjacent", F.coalesce(F.col("_t_index") == F.col("t_index") + 1, F.lit(False)))
    mean = (F.col("p_minus1") + F.col("_p_minus1")) / 2
    alert = F.col("_adjacent") & (mean >= probability)
    if uncertainty is not None:
        alert = alert & (F.col("uncertainty") <= uncertainty) & (F.col("_uncertainty") <= uncertainty)
    alert = F.coalesce(alert, F.lit(False))
    marked = rows.withColumn("_alert", alert).withColumn("_after", F.coalesce(F.lag("_alert").over(w) & (F.lag("t_index").over(w) == F.col("t_index") - 1), F.lit(False)))
    inside = marked.where("_alert or _after")  # the entries that some alerting pair covers
    starts = F.when(F.col("_after"), 0).otherwise(1)
    runs = inside.withColumn("_run", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c: F.max_by(c, "t_index")
    out = runs.groupBy(*keys, "_run").agg(
        F.min("t_index").alias("onset_t_index"), F.max("t_index").alias("end_t_index"), F.count(F.lit(1)).alias("length"), last("_adjacent").alias("_more"),
        last("_p_minus1").alias("_p"), last("_uncertainty").alias("_u"), last("_predicted_class").alias("_c"), F.avg("p_minus1").alias("mean_conflict_evidence"), F.avg("uncertainty").alias("mean_uncertainty"))
    unsure = F.col("_p").isNull() | F.col("_c").isNull()
    if uncertainty is not None:
        unsure = unsure | F.col("_u").isNull() | (F.col("_u") > uncertainty)
    state = F.when(~F.col("_more"), "active").when(unsure, "uncertain").when(F.col("_c") == -1, "active").otherwise("recovered")
    return out.select(
        F.concat_ws("::", *(F.col(k).cast("string") for k in keys), F.col("onset_t_index").cast("string")).alias("episode_id"), *keys, "onset_t_index",
        (F.col("onset_t_index") + 1).alias("confirmation_t_index"), "end_t_index", "length", (~F.col("_more")).alias("open_at_cutoff"), state.alias("delivery_state"), "mean_conflict_evidence", "mean_uncertainty")


def historical_drifts(decisions: DataFrame, keys=KEY) -> DataFrame:
    """Confirmed runs of accepted conflict verdicts, with what ended them: gap, not_conflict, abstain, or null while open."""
    w = along(keys)
    rows = decisions.withColumns({"_next_t": F.lead("t_index").over(w), "_next_verdict": F.lead("verdict").over(w)})
    runs = flagged_runs(rows, (F.col("verdict") == "conflict") & (F.col("review_status") == "ok"), keys)
    out = runs.groupBy(*keys, "run").agg(
        F.min("t_index").alias("onset"), F.max("t_index").alias("end"), F.count(F.lit(1)).alias("length"),
        F.max_by("_next_t", "t_index").alias("_t"), F.max_by("_next_verdict", "t_index").alias("_verdict")).where("length >= 2")
    reason = F.when(F.col("_t").isNull(), None).when(F.col("_t") != F.col("end") + 1, "gap").when(F.col("_verdict") == "not_conflict", "not_conflict").otherwise("abstain")
    return out.withColumn("termination_reason", reason).select(
        *keys, "onset", (F.col("onset") + 1).alias("confirmation"), "end", "length", "termination_reason",
        F.when(F.col("termination_reason") != "gap", F.col("_t")).alias("termination_t_index"))


def unresolved_pairs(decisions: DataFrame, keys=KEY) -> DataFrame:
    """Adjacent pairs with an abstention and no not_conflict."""
    pairs = adjacent_pairs(decisions, keys, columns=("verdict",))
    return pairs.where(F.lit("abstain").isin(F.col("verdict"), F.col("next_verdict")) & ~F.lit("not_conflict").isin(F.col("verdict"), F.col("next_verdict")))


def dips(df: DataFrame, score: str = "score", keys=KEY, within: int = 2) -> DataFrame:
    """Falls from 0 or more to -1, their depth, and whether the score is 0 or more again within `within` entries.

    `recovered` is null for a fall on the last entry.
    """
    w = along(keys)
    rows = df.withColumns({
        "previous": F.lag(score).over(w), "_best": F.max(score).over(_frame(keys, "t_index", 1, within)), "_last": F.lead("t_index").over(w).isNull()})
    return rows.where((F.col("previous") >= 0) & (F.col(score) == -1)).select(
        *keys, "t_index", (F.col("previous") - F.col(score)).alias("severity"), F.when(~F.col("_last"), F.coalesce(F.col("_best") >= 0, F.lit(False))).alias("recovered"))


def fades(df: DataFrame, zeros: int, score: str = "score", keys=KEY) -> DataFrame:
    """Entries of +1 with at least `zeros` observed zeros right after."""
    w = along(keys)
    after = reduce(lambda a, b: a & b, (F.coalesce(F.lead(score, k).over(w) == 0, F.lit(False)) for k in range(1, zeros + 1)))
    return df.withColumn("_fades", after).where((F.col(score) == 1) & F.col("_fades")).drop("_fades")


def sliding_suppression(df: DataFrame, shown: str, keys, order: str, window: int = 3, most: int = 2) -> DataFrame:
    """`suppress`: whether `most` or more of the `window` rows before were shown."""
    before = F.sum(F.col(shown).cast("int")).over(_frame(keys, order, -window, -1))
    return df.withColumn("suppress", F.coalesce(before >= most, F.lit(False)))


def day_gaps(df: DataFrame, day: str = "d", keys=("persona_id",), longest: int = 30, first: float = 7.0) -> DataFrame:
    """Days since the entry before, between 0 and `longest`, as a share of it; `first` days for the first entry."""
    days = F.datediff(day, F.lag(day).over(along(keys))).cast("double")
    return df.withColumn("day_gap", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(float(longest)), days)), F.lit(first)) / longest)


def moving_average(df: DataFrame, value: str, keys, order: str, width: int) -> DataFrame:
    """Centred mean over `width` rows (odd); the first and last value stand in for rows beyond the ends."""
    half, w = width // 2, Window.partitionBy(*keys)
    position, size = F.row_number().over(along(keys, order)), F.count(F.lit(1)).over(w)
    rows = df.withColumns({"_i": position, "_n": size, "_first": F.first(value).over(_frame(keys, order, Window.unboundedPreceding, Window.unboundedFollowing)),
                           "_final": F.last(value).over(_frame(keys, order, Window.unboundedPreceding, Window.unboundedFollowing)), "_sum": F.sum(value).over(_frame(keys, order, -half, half))})
    before, after = F.greatest(F.lit(0), F.lit(half + 1) - F.col("_i")), F.greatest(F.lit(0), F.lit(half) - (F.col("_n") - F.col("_i")))
    return rows.withColumn("smoothed", (F.col("_sum") + before * F.col("_first") + after * F.col("_final")) / width).drop("_i", "_n", "_first", "_final", "_sum")


def history_rows(df: DataFrame, values: list[str], steps: int, keys=KEY, by_index: bool = False, fill: float = 0.0) -> DataFrame:
    """`values` of up to `steps` rows before, as before_<k>_<value>.

    By position, or with `by_index` only where the number is t_index - k; `fill` stands for rows that are missing.
    """
    w = along(keys)
    if not by_index:
        return df.withColumns({f"before_{k}_{v}": F.coalesce(F.lag(v, k).over(w), F.lit(fill)) for v in values for k in range(1, steps + 1)})
    # Rows numbered t - k lie in a range frame of width one, whatever stands between them.
    return df.withColumns({f"before_{k}_{v}": F.coalesce(F.max(v).over(w.rangeBetween(-k, -k)), F.lit(fill)) for v in values for k in range(1, steps + 1)})
