"""The reviewer's three-state machine and the matching of episodes, without a group that has to be held whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.operators.sequence import KEY, along, coverage

UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def transitions(decisions: DataFrame, keys=KEY) -> DataFrame:
    """State, run length, gap and effect after each decision of a trajectory.

    A not_conflict clears the trajectory, so what counts is the segment since the last one: it is `open` once it holds an
    accepted conflict or a failed review. In an open segment an abstention, a gap or a failed review leaves insufficient
    evidence until two adjacent conflicts confirm. That makes the machine a handful of window functions.
    """
    w = along(keys)
    ok = F.col("review_status") == "ok"
    gap = F.coalesce(F.col("t_index") != F.lag("t_index").over(w) + 1, F.lit(False))
    rows = decisions.withColumns({"_conflict": ok & (F.col("verdict") == "conflict"), "_clear": ok & (F.col("verdict") == "not_conflict"), "_failed": ~ok, "gap_before": gap})
    rows = rows.withColumns({
        "_segment": F.coalesce(F.sum(F.col("_clear").cast("int")).over(w.rowsBetween(*BEFORE)), F.lit(0)),
        "_breaks": F.sum(F.when(F.col("_conflict") & ~F.col("gap_before"), 0).otherwise(1)).over(w.rowsBetween(*UP_TO))})
    segment, stretch = along((*keys, "_segment")), along((*keys, "_breaks"))
    rows = rows.withColumns({
        "_open": F.coalesce(F.max(F.col("_conflict") | F.col("_failed")).over(segment.rowsBetween(*BEFORE)), F.lit(False)),
        "_nth": F.sum(F.col("_conflict").cast("int")).over(stretch.rowsBetween(*UP_TO)),
        # A stretch begins at a break; that row is of the run itself only if it is a conflict.
    })
    run = F.when(F.col("_conflict"), F.col("_nth")).otherwise(0).cast("long")
    rows = rows.withColumn("run_length", run)
    open_, conflict = F.col("_open"), F.col("_conflict")
    insufficient = F.lit("insufficient_evidence")
    state = F.when(F.col("_failed"), insufficient).when(F.col("_clear"), "no_active_drift").when(
        conflict & (F.col("run_length") >= 2), "active_drift").when(open_, insufficient).otherwise("no_active_drift")
    effect = F.when(F.col("_failed"), "insufficient").when(F.col("_clear"), F.when(open_, "end").otherwise("reset")).when(
        conflict, F.when(F.col("run_length") == 1, "start").when(F.col("run_length") == 2, "confirm").otherwise("extend")).otherwise(
        F.when(open_, "insufficient").otherwise("reset"))
    return rows.withColumns({"state": state, "effect": effect}).drop("_conflict", "_clear", "_failed", "_segment", "_breaks", "_open", "_nth")


def state_rank(state: Column) -> Column:
    """active_drift 2, insufficient_evidence 1, no_active_drift 0: the order of delivery."""
    return F.when(state == "active_drift", 2).when(state == "insufficient_evidence", 1).otherwise(0)


def current_states(decisions: DataFrame, keys=KEY) -> DataFrame:
    """The last row of each trajectory's transitions."""
    last = lambda c: F.max_by(c, "t_index").alias(c)
    return transitions(decisions, keys).groupBy(*keys).agg(last("state"), last("run_length"), last("verdict"), last("review_status"), F.max("t_index").alias("t_index"), F.max("d").alias("d"))


def delivery(decisions: DataFrame, keys=KEY, by=("persona_id",)) -> DataFrame:
    """Delivery state of each persona: active before insufficient before none, with the cutoff of its latest decision."""
    states = current_states(decisions, keys)
    rank = F.max(state_rank(F.col("state")))
    name = F.when(rank == 2, "active_drift").when(rank == 1, "insufficient_evidence").otherwise("no_active_drift")
    return states.groupBy(*by).agg(name.alias("delivery_state"), F.max("t_index").alias("cutoff_t_index"), F.max("d").alias("cutoff_d"), F.count_if(F.col("state") == "active_drift").alias("n_active"))


def match_episodes(reference: DataFrame, predicted: DataFrame, lag: int = 2, keys=KEY) -> DataFrame:
    """One-to-one matches of references, in order, with the earliest unused prediction confirmed in [onset, end + lag].

    Greedy matching depends on order, but only within references whose windows overlap. One pass over the merged rows of
    a trajectory numbers such islands, and each island (a few rows, however long the trajectory) is folded by itself.
    """
    spot = lambda kind, at, until: F.struct(F.lit(kind).alias("kind"), F.col("episode_id"), F.col("onset_t_index").alias("onset"), F.col("confirmation_t_index").alias("conf"), until.alias("until"), F.col("delivery_state").alias("state"))
    refs = reference.select(*keys, F.col("onset_t_index").alias("_at"), F.lit(0).alias("_kind"), spot(0, "onset", F.col("end_t_index") + lag).alias("row"))
    preds = predicted.select(*keys, F.col("confirmation_t_index").alias("_at"), F.lit(1).alias("_kind"), spot(1, "conf", F.lit(None).cast("long")).alias("row"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", "row.episode_id")
    rows = refs.unionByName(preds).withColumn("_reach", F.max("row.until").over(w.rowsBetween(*BEFORE)))
    starts = (F.col("_kind") == 0) & (F.col("_reach").isNull() | (F.col("_at") > F.col("_reach")))
    rows = rows.withColumn("island", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(*UP_TO)))
    rows = rows.where((F.col("_kind") == 0) | (F.col("_at") <= F.col("_reach")))
    of = lambda kind: F.collect_list(F.when(F.col("_kind") == kind, F.col("row")))
    islands = rows.groupBy(*keys, "island").agg(of(0).alias("refs"), of(1).alias("preds")).where((F.size("refs") > 0) & (F.size("preds") > 0))
    order = lambda a, b: F.when(a["conf"] < b["conf"], -1).when(a["conf"] > b["conf"], 1).when(a["episode_id"] < b["episode_id"], -1).when(a["episode_id"] > b["episode_id"], 1).otherwise(0)
    islands = islands.select(*keys, F.array_sort("refs", order).alias("refs"), F.array_sort("preds", order).alias("preds"))
    kind = islands.schema["refs"].dataType.elementType.simpleString()
    empty = F.expr(f"cast(array() as array<struct<ref:{kind},pred:{kind}>>)")

    def step(found, ref):
        free = F.filter("preds", lambda p: (p["conf"] >= ref["onset"]) & (p["conf"] <= ref["until"]) & ~F.exists(found, lambda f: f["pred"]["episode_id"] == p["episode_id"]))
        return F.when(F.size(free) > 0, F.concat(found, F.array(F.struct(ref.alias("ref"), F.get(free, F.lit(0)).alias("pred"))))).otherwise(found)

    pairs = islands.select(*keys, F.inline(F.aggregate("refs", empty, step)))
    return pairs.select(
        *keys, F.col("ref.episode_id").alias("reference_episode_id"), F.col("pred.episode_id").alias("predicted_episode_id"), F.col("ref.conf").alias("reference_confirmation"),
        F.col("pred.conf").alias("predicted_confirmation"), (F.col("pred.conf") - F.col("ref.conf")).alias("latency_entries"), F.col("ref.state").alias("reference_state"), F.col("pred.state").alias("predicted_state"))


def inside_reference(points: DataFrame, reference: DataFrame, at: str, keys=KEY) -> DataFrame:
    """`points` with `inside`: whether `at` lies in one of the key's reference episodes.

    The episodes of a key never overlap, so the one with the largest onset up to the point decides: one pass, no range join.
    """
    names = [c for c in points.columns if c not in keys]
    p = points.select(*keys, F.struct(*names).alias("_row"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    r = reference.select(*keys, F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col("onset_t_index").alias("_at"), F.lit(0).alias("_kind"), F.col("end_t_index").cast("long").alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(*UP_TO)
    out = p.unionByName(r).withColumn("_reach", F.last("_end", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(*keys, "_row.*", F.coalesce(F.col("_at") <= F.col("_reach"), F.lit(False)).alias("inside"))


def episode_metrics(reference: DataFrame, predicted: DataFrame, eligible: DataFrame, decisions: DataFrame, lag: int = 2, keys=KEY) -> DataFrame:
    """One row: hits, precision, recall, F1, false alarms by trajectory and window, latency, agreement on delivery and recovery.

    `eligible` has n_entries per trajectory, `decisions` window_end and alert.
    """
    matches = match_episodes(reference, predicted, lag, keys)
    hits = matches.agg(
        F.count(F.lit(1)).alias("true_positive"), F.avg("latency_entries").alias("mean_latency"), F.max("latency_entries").alias("max_latency"), F.expr("median(latency_entries)").alias("median_latency"),
        F.count_if(F.col("reference_state") == F.col("predicted_state")).alias("delivery_correct"), F.count_if(F.col("reference_state") == "recovered").alias("recovery_cases"),
        F.count_if((F.col("reference_state") == "recovered") & (F.col("predicted_state") == "recovered")).alias("recovery_correct"))
    sizes = reference.agg(F.count(F.lit(1)).alias("reference_episodes")).crossJoin(predicted.agg(F.count(F.lit(1)).alias("predicted_episodes")))  # one row each
    negative = eligible.where("n_entries >= 2").select(*keys).distinct().join(reference.select(*keys).distinct(), list(keys), "left_anti")
    alarmed = negative.join(predicted.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left").agg(
        F.count(F.lit(1)).alias("negative_trajectories"), F.count("_hit").alias("false_alarm_trajectories"))
    windows = inside_reference(decisions.select(*keys, "window_end", "alert"), reference, "window_end", keys).where("not inside").agg(
        F.count(F.lit(1)).alias("negative_windows"), F.count_if("alert").alias("alerted_windows"))
    row = hits.crossJoin(sizes).crossJoin(alarmed).crossJoin(windows)  # one row each
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    row = row.withColumns({"precision": ratio("true_positive", "predicted_episodes"), "recall": ratio("true_positive", "reference_episodes")})
    return row.withColumns({
        "f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
        "trajectory_false_alarm_rate": ratio("false_alarm_trajectories", "negative_trajectories"),
        "false_positive_rate": F.try_divide(F.col("alerted_windows"), F.col("negative_windows")),
        "delivery_accuracy": F.try_divide(F.col("delivery_correct"), F.col("true_positive")),
        "recovery_accuracy": F.try_divide(F.col("recovery_correct"), F.col("recovery_cases"))})


def merge_overlaps(spans: DataFrame, case: str = "case_id") -> DataFrame:
    """Spans (case, alert, onset, end) merged in (alert, onset) order: a span joins the first kept span that it overlaps.

    The kept span keeps its own alert and onset; its end grows. Spans that no chain of overlaps connects never meet, so
    each chain is folded by itself.
    """
    w = Window.partitionBy(case).orderBy("onset", "end")
    rows = spans.withColumn("_reach", F.max("end").over(w.rowsBetween(*BEFORE)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col("onset") > F.col("_reach")), 1).otherwise(0)).over(w.rowsBetween(*UP_TO)))
    islands = rows.groupBy(case, "_island").agg(F.sort_array(F.collect_list(F.struct("alert", "onset", "end"))).alias("spans"))
    kind = islands.schema["spans"].dataType.simpleString()

    def step(kept, s):
        at = F.aggregate(kept, F.struct(F.lit(0).alias("i"), F.lit(0).alias("hit")), lambda a, k: F.struct(
            (a["i"] + 1).alias("i"), F.when((a["hit"] == 0) & (s["onset"] <= k["end"]) & (s["end"] >= k["onset"]), a["i"] + 1).otherwise(a["hit"]).alias("hit")))["hit"]
        grown = F.transform(kept, lambda k, i: F.struct(k["alert"].alias("alert"), k["onset"].alias("onset"), F.when(i + 1 == at, F.greatest(k["end"], s["end"])).otherwise(k["end"]).alias("end")))
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(s)))

    return islands.select(case, F.inline(F.aggregate("spans", F.expr(f"cast(array() as {kind})"), step)))


def scheduled_episodes(weekly: DataFrame, early: DataFrame, records: DataFrame, keys=KEY, by: str = "persona_id") -> tuple[DataFrame, DataFrame]:
    """Episodes of weekly reviews and earlier scheduled ones together: (keys, alert, onset, end), and the coverage of each trajectory.

    weekly: keys, t_index, d and label (true, false, or null without a verdict) of every entry; early: keys, t_index and label;
    records: by, record_id, week_start, cutoff and review_at, the early reviews. At an early review the entries up to its cutoff
    are known: those of its week by early labels, those before by weekly ones. Its alerts come at review_at, weekly ones on the
    Monday after the confirming entry. Overlapping episodes are merged, the earliest alert first.

    Of what an early review sees only runs that reach into its week are new; the others are beginnings of weekly episodes that
    alert no later. So each review is joined with its own week's entries, and a run that was open before the week goes on from
    its onset: no snapshot of the whole history is made.
    """
    w = along(keys)
    true = F.coalesce(F.col("label"), F.lit(False))
    near = F.coalesce(F.col("t_index") == F.lag("t_index").over(w) + 1, F.lit(False))
    rows = weekly.withColumns({"_true": true, "_near": near, "week_start": F.date_trunc("week", "d").cast("date")})
    rows = rows.withColumn("_goes_on", F.col("_near") & F.coalesce(F.lag("_true").over(w), F.lit(False)))
    rows = rows.withColumn("_run", F.when(F.col("_true"), F.last(F.when(F.col("_true") & ~F.col("_goes_on"), F.col("t_index")), ignorenulls=True).over(w.rowsBetween(*UP_TO))))
    rows = rows.withColumn("_carry", F.when(F.col("_goes_on"), F.lag("_run").over(w)))
    monday = F.date_add("week_start", 7)
    spans = rows.where("_true").groupBy(*keys, "_run").agg(F.max("t_index").alias("end"), F.max(F.when(F.col("t_index") == F.col("_run") + 1, monday)).alias("alert"))
    spans = spans.where(F.col("end") > F.col("_run")).select(*keys, "alert", F.col("_run").alias("onset"), "end")

    seen = rows.join(records.select(by, "week_start", "record_id", "cutoff", "review_at"), [by, "week_start"]).where(F.col("t_index") <= F.col("cutoff"))
    seen = seen.join(early.select(*keys, "t_index", F.col("label").alias("_early")), [*keys, "t_index"], "left")
    of = along((*keys, "record_id"))
    hit = F.coalesce(F.col("_early"), F.lit(False))
    seen = seen.withColumns({"_hit": hit, "_first": F.row_number().over(of) == 1, "_beside": F.coalesce(F.lag(hit).over(of) & (F.lag("t_index").over(of) == F.col("t_index") - 1), F.lit(False))})
    begins = F.when(F.col("_hit") & ~F.col("_beside"), F.when(F.col("_first"), F.coalesce("_carry", "t_index")).otherwise(F.col("t_index")))
    seen = seen.withColumn("_begin", F.last(begins, ignorenulls=True).over(of.rowsBetween(*UP_TO)))
    sooner = seen.where("_hit").groupBy(*keys, "record_id", "_begin").agg(F.max("t_index").alias("end"), F.max("review_at").alias("alert")).where(F.col("end") > F.col("_begin")).select(*keys, "alert", F.col("_begin").alias("onset"), "end")

    packed = spans.unionByName(sooner).select(F.struct(*keys).alias("_case"), "alert", "onset", "end")
    merged = merge_overlaps(packed, "_case").select("_case.*", "alert", "onset", "end")
    filled = seen.where("_early is not null").groupBy(*keys, "t_index").agg(F.min_by("_early", "record_id").alias("_fill"))
    known = weekly.join(filled, [*keys, "t_index"], "left").withColumn("label", F.coalesce("label", "_fill"))
    return merged, coverage(known, keys=keys)
