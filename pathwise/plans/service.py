"""Session log and source queries (survey rows T*, S16, S18, X49)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise import adapter
from pathwise.adapter import table
from pathwise.plans.base import Plans
from pathwise.plans.sequence import CORE, MACHINE, _recursive
from pathwise.sources import readers
from pathwise.streaming import reviews, sessions

plans = Plans()


def _log(spark, sf):
    """Events as session requests: positions in order, some repeated, some late."""
    e = adapter.entry(spark, sf)
    t, k = F.col("t_index"), F.col("event_id")
    back = k % 9 == 0
    return e.select(F.col("persona_id").cast("string").alias("session_id"), F.lit("entry").alias("kind"), F.concat(F.lit("k"), F.when(k % 7 == 0, k - 1).otherwise(k).cast("string")).alias("key"), t.alias("revision"), F.concat(F.lit("e"), k.cast("string")).alias("entry_id"),
                    F.when(back, t - 1).otherwise(t).alias("t_index"), F.col("d").cast("string").alias("date"), F.lit("").alias("body"), t.alias("seq_in"))


@plans.add("t02_ordered_ingest", _recursive("""WITH RECURSIVE ev AS (SELECT persona_id AS s, t_index AS i, d, CASE WHEN event_id % 7 = 0 THEN event_id - 1 ELSE event_id END AS key, CASE WHEN event_id % 9 = 0 THEN t_index - 1 ELSE t_index END AS t FROM entry),
k AS (SELECT *, row_number() OVER (PARTITION BY s, key ORDER BY i) > 1 AS again FROM ev),
m AS (SELECT DISTINCT s, CAST(-1 AS BIGINT) AS i, NULL::DATE AS d, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS last_t, CAST(NULL AS VARCHAR) AS why FROM ev
  UNION ALL
  SELECT s, i, d, CASE WHEN why IS NULL THEN r + 1 ELSE r END, CASE WHEN why IS NULL THEN list_append(taken, t) ELSE taken END, CASE WHEN why IS NULL THEN t ELSE last_t END, why FROM (
    SELECT k.s, k.i, k.d, k.t, m.r, m.taken, m.last_t, CASE WHEN k.again THEN 'key was used for another request' WHEN k.i <> m.r THEN 'stale revision' WHEN list_contains(m.taken, k.t) THEN 'position is taken' WHEN k.t <= m.last_t THEN 'position goes back' END AS why
    FROM m JOIN k ON k.s = m.s AND k.i = m.i + 1))
SELECT CASE WHEN why IS NULL THEN 'accepted' WHEN why LIKE 'key%' THEN 'conflict' ELSE 'rejected' END AS outcome, why AS reason, count(*) AS n FROM m WHERE i >= 0 GROUP BY 1, 2
UNION ALL SELECT 'week_closed', NULL, CAST(sum(n - 1) AS BIGINT) FROM (SELECT s, count(DISTINCT date_trunc('week', d)) AS n FROM m WHERE i >= 0 AND why IS NULL GROUP BY 1) HAVING sum(n - 1) > 0"""))
def ordered(spark, sf):
    return sessions.replay(_log(spark, sf)).groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


@plans.add("t04_week_close", "SELECT * FROM (SELECT persona_id, CAST(date_trunc('week', d) AS DATE) AS week_start, count(*) AS n FROM entry GROUP BY 1, 2) WHERE week_start + 6 < DATE '2024-01-20'", views=True)
def _(spark, sf):
    e = adapter.entry(spark, sf).groupBy("persona_id", F.date_trunc("week", "d").cast("date").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    return e.where(F.date_add("week_start", 6) < F.lit("2024-01-20").cast("date"))


@plans.add("t10_cursor_read", "SELECT event_id FROM events WHERE event_id > 500 AND user_id = 3")
def _(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("session_id"))
    return sessions.trace_after(log, 500, "3").select(F.col("seq").alias("event_id"))


@plans.add("t14_replay_weeks", "SELECT persona_id, event_id FROM entry WHERE d <= DATE '2024-01-14'", views=True)
def _(spark, sf):
    return adapter.entry(spark, sf).where(F.col("d") <= F.lit("2024-01-14").cast("date")).select("persona_id", "event_id")


@plans.add("s16_run_union", "SELECT 'a' AS run_id, count(*) AS n FROM nation UNION ALL SELECT 'b', count(*) FROM region")
def _(spark, sf):
    return readers.union_runs(spark, {"a": f"{sf}/nation.parquet", "b": f"{sf}/region.parquet"}).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@plans.add("s18_packed_arrays", "SELECT event_id, string_agg(coalesce(CAST(score AS VARCHAR), 'x'), ',' ORDER BY dim_index) AS scores FROM label GROUP BY 1", views=True)
def _(spark, sf):
    p = readers.packed(adapter.label(spark, sf), ["event_id"], ["score"])
    return p.select("event_id", F.array_join(F.transform("score", lambda x: F.coalesce(x.cast("string"), F.lit("x"))), ",").alias("scores"))


@plans.add("x49_snapshot", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").select("user_id").distinct().orderBy("user_id")


# Reviews of the sessions: nudges, statuses and reviews are made of the entries and decisions by whole-number rules.

NUDGES = """nudge AS (SELECT persona_id, event_id, CASE event_id % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'answered' ELSE CASE WHEN event_id % 60 = 2 THEN 'displayed' ELSE 'expired' END END AS outcome FROM entry WHERE event_id % 6 < 3),
status AS (SELECT persona_id, event_id, 1 AS seq, CASE event_id % 4 WHEN 0 THEN 'error' ELSE 'complete' END AS status FROM entry WHERE event_id % 50 <> 0 UNION ALL SELECT persona_id, event_id, 2, 'invalid' FROM entry WHERE event_id % 8 = 0)"""


def _nudges(spark, sf):
    e = adapter.entry(spark, sf)
    k = F.col("event_id")
    outcome = F.when(k % 6 == 0, "skipped").when(k % 6 == 1, "answered").when(k % 60 == 2, "displayed").otherwise("expired")
    statuses = F.inline(F.array_compact(F.array(
        F.when(k % 50 != 0, F.struct(F.lit(1).alias("seq"), F.when(k % 4 == 0, "error").otherwise("complete").alias("status"))),
        F.when(k % 8 == 0, F.struct(F.lit(2).alias("seq"), F.lit("invalid").alias("status"))))))
    return e, e.where("event_id % 6 < 3").select("persona_id", "event_id", outcome.alias("outcome")), e.select("persona_id", "event_id", statuses)


FINAL = f"""WITH {NUDGES}, last AS (SELECT persona_id, event_id, arg_max(status, seq) AS status FROM status GROUP BY 1, 2),
fin AS (SELECT e.persona_id, CAST(date_trunc('week', e.d) AS DATE) AS week, count(*) AS n_entries, bool_and((n.outcome IS NOT NULL OR coalesce(l.status IN ('complete', 'refused', 'invalid'), false)) AND coalesce(n.outcome, '') <> 'displayed') AS finalized
  FROM entry e LEFT JOIN nudge n ON n.event_id = e.event_id LEFT JOIN last l ON l.event_id = e.event_id GROUP BY 1, 2)"""


@plans.add("t05_finalized_weeks", FINAL + " SELECT * FROM fin", views=True)
def _(spark, sf):
    return reviews.finalized_weeks(*_nudges(spark, sf))


@plans.add("t04_due_weeks", FINAL + ", r AS (SELECT DISTINCT persona_id, CAST(date_trunc('week', d) AS DATE) AS week FROM entry WHERE event_id % 3 = 0 AND persona_id % 2 = 0) SELECT f.persona_id, f.week, row_number() OVER (PARTITION BY f.persona_id ORDER BY f.week) AS place FROM fin f LEFT JOIN r ON r.persona_id = f.persona_id AND r.week = f.week WHERE finalized AND f.week + 6 < DATE '2024-01-25' AND r.week IS NULL", views=True)
def _(spark, sf):
    e, n, s = _nudges(spark, sf)
    reviewed = e.where("event_id % 3 = 0 and persona_id % 2 = 0").select("persona_id", F.date_trunc("week", "d").cast("date").alias("week"))
    return reviews.due_weeks(reviews.finalized_weeks(e, n, s), reviewed, F.lit("2024-01-25").cast("date")).select("persona_id", "week", "place")


@plans.add("t06_state_suppression", f"WITH {NUDGES}, s AS (SELECT e.persona_id, e.event_id, e.t_index, coalesce(n.outcome IN ('displayed', 'skipped', 'answered'), false) AS shown FROM entry e LEFT JOIN nudge n ON n.event_id = e.event_id) SELECT persona_id, event_id, coalesce(sum(CAST(shown AS INTEGER)) OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 2, false) AS suppress FROM s", views=True)
def _(spark, sf):
    e, n, _s = _nudges(spark, sf)
    return reviews.suppressed(e, n).select("persona_id", "event_id", "suppress")


REVIEWS = """weekly AS (SELECT *, CAST(date_trunc('week', d) AS DATE) AS week FROM decision),
review AS (SELECT *, 1 AS review FROM weekly UNION ALL SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 'not_conflict' ELSE verdict END AS verdict), 2 FROM weekly WHERE persona_id % 3 = 0 AND day(week) % 2 = 0)"""


def _reviews(spark, sf):
    rows = adapter.decision(spark, sf).withColumn("week", F.date_trunc("week", "d").cast("date"))
    again = rows.where((F.col("persona_id") % 3 == 0) & (F.dayofmonth("week") % 2 == 0)).withColumn("verdict", F.when(F.col("event_id") % 2 == 0, "not_conflict").otherwise(F.col("verdict")))
    return rows.withColumn("review", F.lit(1)).unionByName(again.withColumn("review", F.lit(2)))


def _standing(where: str = "true") -> str:
    """The state machine over the reviews that stand."""
    latest = f"{REVIEWS}, latest AS (SELECT * FROM (SELECT *, max(review) OVER (PARTITION BY persona_id, week) AS top FROM review) WHERE review = top AND {where})"
    return "WITH RECURSIVE " + latest + ", " + MACHINE.strip().removeprefix("WITH RECURSIVE").strip().replace("FROM decision", "FROM latest")


@plans.add("t07_weekly_review", _recursive(_standing() + """, w AS (SELECT m.persona_id, m.dimension, l.week, arg_max(m.state, m.t_index) AS state, CAST(arg_max(m.run, m.t_index) AS BIGINT) AS run_length, count(*) AS n_current FROM m JOIN latest l ON l.persona_id = m.persona_id AND l.dimension = m.dimension AND l.t_index = m.t_index GROUP BY ALL)
SELECT *, CAST(sum(n_current) OVER (PARTITION BY persona_id, dimension ORDER BY week) AS BIGINT) AS n_history FROM w"""))
def _(spark, sf):
    return reviews.weekly_review(_reviews(spark, sf))


CORRECTED = "SELECT persona_id, min(CAST(date_trunc('week', d) AS DATE)) AS affected FROM entry WHERE event_id % 40 = 7 GROUP BY 1"


@plans.add("t08_retracted_states", _recursive(_standing(f"week < coalesce((SELECT affected FROM ({CORRECTED}) c WHERE c.persona_id = top_.persona_id), DATE '9999-01-01')").replace("FROM review) WHERE", "FROM review) top_ WHERE") + " SELECT persona_id, dimension, arg_max(state, t_index) AS state, max(t_index) AS t_index FROM m GROUP BY 1, 2"))
def _(spark, sf):
    from pathwise.operators import episodes

    e = adapter.entry(spark, sf)
    kept, _again = reviews.retract(_reviews(spark, sf), e, e.where("event_id % 40 = 7"))
    return episodes.current_states(reviews.standing(kept)).select(*CORE, "state", "t_index")


@plans.add("t08_weeks_again", f"WITH {REVIEWS}, c AS ({CORRECTED}) SELECT r.persona_id, r.week, row_number() OVER (PARTITION BY r.persona_id ORDER BY r.week) AS place FROM (SELECT DISTINCT persona_id, week FROM review) r JOIN c ON c.persona_id = r.persona_id WHERE r.week >= c.affected AND EXISTS (SELECT 1 FROM entry e WHERE e.persona_id = r.persona_id AND e.event_id % 40 <> 7 AND CAST(date_trunc('week', e.d) AS DATE) = r.week)", views=True)
def _(spark, sf):
    e = adapter.entry(spark, sf)
    return reviews.retract(_reviews(spark, sf), e.where("event_id % 40 <> 7"), e.where("event_id % 40 = 7"))[1]  # deleted entries


@plans.add("t09_next_clock", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) + 1 WHEN 1 THEN CAST(date_trunc('week', ts) AS DATE) + 7 END AS clock FROM events")
def _(spark, sf):
    step = F.when(F.col("event_id") % 3 == 0, "next_day").when(F.col("event_id") % 3 == 1, "close_week").otherwise("stay")
    return table(spark, sf, "events").select("event_id", reviews.next_clock(F.col("ts").cast("date"), step).alias("clock"))


@plans.add("t12_rule_steps", _recursive(MACHINE + "SELECT persona_id, dimension, t_index, verdict, CAST(run AS BIGINT) AS run_length, state, gap AS gap_before, effect FROM m"))
def _(spark, sf):
    return reviews.rule_steps(adapter.decision(spark, sf))
