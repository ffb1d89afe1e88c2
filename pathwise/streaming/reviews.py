"""Weekly reviews of journal sessions as data: which weeks are due, what a review replaces, what a correction takes back.

A log of reviews has one row per decision with the week and number of its review. All functions are joins, windows and
aggregations over the log, so a day's worth of sessions is recomputed by all executors, and a correction recomputes only
the sessions that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise.functions.scalars import week_start
from pathwise.operators import episodes, sequence

#: Outcomes of a nudge that count as shown, and statuses by which an entry's nudge is decided: fixed values.
SHOWN = ("displayed", "skipped", "answered")
DECIDED = ("complete", "refused", "invalid")


def finalized_weeks(entries: DataFrame, nudges: DataFrame, statuses: DataFrame, by=("persona_id",), entry: str = "event_id") -> DataFrame:
    """by, week, n_entries and finalized: no nudge of the week is still displayed, and every entry has a nudge or its latest
    status (of statuses: by, entry, seq, status) is a decided one."""
    keys = [*by, entry]
    one = nudges.groupBy(*keys).agg(F.bool_or(F.col("outcome") == "displayed").alias("_waits"), F.lit(True).alias("_nudged"))
    last = statuses.groupBy(*keys).agg(F.max_by("status", "seq").alias("_status"))
    rows = entries.select(*keys, week_start("d").alias("week")).join(one, keys, "left").join(last, keys, "left")
    settled = F.coalesce(F.col("_nudged"), F.lit(False)) | F.coalesce(F.col("_status").isin(*DECIDED), F.lit(False))
    done = F.bool_and(settled & ~F.coalesce(F.col("_waits"), F.lit(False)))
    return rows.groupBy(*by, "week").agg(F.count(F.lit(1)).alias("n_entries"), done.alias("finalized"))


def due_weeks(finalized: DataFrame, reviewed: DataFrame, as_of: Column, by=("persona_id",)) -> DataFrame:
    """Finalized weeks that ended before `as_of` and have no review, with their place in the session's order."""
    open_ = finalized.where(F.col("finalized") & (F.date_add("week", 6) < as_of)).join(reviewed.select(*by, "week").distinct(), [*by, "week"], "left_anti")
    return open_.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("week")))


def suppressed(entries: DataFrame, nudges: DataFrame, by=("persona_id",), entry: str = "event_id") -> DataFrame:
    """`entries` with `suppress`: two or more of the three entries before had a nudge that was shown."""
    shown = nudges.where(F.col("outcome").isin(*SHOWN)).select(*by, entry).distinct().withColumn("shown", F.lit(True))
    return sequence.sliding_suppression(entries.join(shown, [*by, entry], "left").withColumn("shown", F.coalesce("shown", F.lit(False))), "shown", list(by), "t_index")


def standing(reviews: DataFrame, by=("persona_id",)) -> DataFrame:
    """The rows of each week's last review: it replaces what earlier ones decided."""
    last = F.max("review").over(Window.partitionBy(*by, "week"))
    return reviews.withColumn("_last", last).where(F.col("review") == F.col("_last")).drop("_last")


def weekly_review(reviews: DataFrame, keys=sequence.KEY) -> DataFrame:
    """State of each trajectory at the end of each week that it was reviewed in, with how many decisions stand until then."""
    rows = episodes.transitions(standing(reviews), keys)
    last = lambda c: F.max_by(c, "t_index").alias(c)
    weeks = rows.groupBy(*keys, "week").agg(last("state"), last("run_length"), F.count(F.lit(1)).alias("n_current"))
    return weeks.withColumn("n_history", F.sum("n_current").over(Window.partitionBy(*keys).orderBy("week")))


def retract(reviews: DataFrame, entries: DataFrame, corrections: DataFrame, by=("persona_id",)) -> tuple[DataFrame, DataFrame]:
    """After corrections (by, d: dates of edited or deleted entries): the reviews that stand, those of weeks before the first
    affected one; and the weeks to review again in order, reviewed ones from it on that still have an entry."""
    first = corrections.groupBy(*by).agg(F.min(week_start("d")).alias("_affected"))
    known = reviews.join(first, list(by), "left")
    kept = known.where(F.col("_affected").isNull() | (F.col("week") < F.col("_affected"))).drop("_affected")
    weeks = entries.select(*by, week_start("d").alias("week")).distinct()
    again = known.where(F.col("week") >= F.col("_affected")).select(*by, "week").distinct().join(weeks, [*by, "week"], "left_semi")
    return kept, again.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("week")))


def next_clock(clock, step) -> Column:
    """The session's date after `next_day` or `close_week`, which goes to the next Monday; another step is null."""
    clock, step = (F.col(x) if isinstance(x, str) else x for x in (clock, step))
    return F.when(step == "next_day", F.date_add(clock, 1)).when(step == "close_week", F.date_add(week_start(clock), 7))


def rule_steps(decisions: DataFrame, keys=sequence.KEY) -> DataFrame:
    """The state machine's steps for inspection: keys, t_index, verdict, run_length, state, gap_before, effect."""
    return episodes.transitions(decisions, keys).select(*keys, "t_index", "verdict", "run_length", "state", "gap_before", "effect")
