"""Sessions on typed state over the test tables: linked events, reviews, retraction, injected judges (survey rows T1 to T8, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.operators import episodes, judges
from pathwise.plans.base import Plans
from pathwise.plans.sequence import MACHINE, _recursive
from pathwise.streaming import live

plans = Plans()

VALUES = ("power", "security")


def _number(entry: dict) -> int:
    return int(entry["entry_id"].removeprefix("e"))


def _nudge(entry: dict) -> dict:
    return {"status": "error" if _number(entry) % 25 == 3 else "refusal" if _number(entry) % 10 == 4 else "ok", "display": False}


def _verdict(number: int, place: int) -> str:
    return ("conflict", "conflict", "conflict", "conflict", "not_conflict", "not_conflict", "abstain", "abstain", "abstain", "abstain")[(number * 11 + place * 7) % 10]


def _review(request: dict) -> dict:
    if int(request["week_start"][8:]) % 5 == 0:
        return {"status": "refusal", "verdicts": {}}
    return {"status": "ok", "verdicts": {(e["t_index"], value): _verdict(_number(e), place) for e in request["entries"] for place, value in enumerate(request["values"])}}


def _coach(request: dict) -> dict:
    return {"status": "ok" if request["drift"] == "active_drift" else "error"}


JUDGES = live.Judges(VALUES, _nudge, _review, _coach)


def _requests(spark, sf, removed: bool):
    """Every user's entries in order, as requests; then, if asked for, the removal of some."""
    e = adapter.entry(spark, sf)
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    session = F.col("persona_id").cast("string").alias("session_id")
    kind = lambda x: F.lit(x).alias("kind")
    out = e.select(session, kind("entry"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), F.col("t_index").alias("revision"), name.alias("entry_id"), "t_index", F.col("d").cast("string").alias("date"), no_text.alias("body"), F.col("t_index").alias("seq_in"))
    if removed:
        gone = e.where("event_id % 40 = 7").select(session, kind("remove"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("key"), no_number.alias("revision"), name.alias("entry_id"), no_number.alias("t_index"), no_text.alias("date"), no_text.alias("body"), (F.col("t_index") + (1 << 40)).alias("seq_in"))
        out = out.unionByName(gone)
    return out


#: Events whose sessions a task replays.
EVENTS = 20_000


def _log(spark, sf, removed: bool, row: str):
    """The log's rows of one kind."""
    parts = max(spark.sparkContext.defaultParallelism, -(-adapter.table(spark, sf, "events").count() // EVENTS))
    return live.replay(_requests(spark, sf, removed), JUDGES, row, parts)


#: Weeks of the entries, which are reviewed (all nudges decided, a later week has begun), and what follows which.
WEEKS = """wk AS (SELECT *, CAST(date_trunc('week', d) AS DATE) AS week FROM entry),
weeks AS (SELECT persona_id, week, bool_and(event_id % 25 <> 3) AS decided, week < max(max(week)) OVER (PARTITION BY persona_id) AS ended, min(t_index) AS first_t, lead(min(t_index)) OVER (PARTITION BY persona_id ORDER BY week) AS next_t FROM wk GROUP BY persona_id, week),
reviewed AS (SELECT * FROM weeks WHERE decided AND ended)"""


@plans.add("t01_linked_events", f"""WITH {WEEKS},
sub AS (SELECT w.persona_id, w.week, CASE WHEN w.t_index = 0 THEN NULL WHEN r.persona_id IS NOT NULL THEN 'weekly_coach_generated' ELSE 'nudge_decided' END AS before, event_id
  FROM wk w LEFT JOIN reviewed r ON r.persona_id = w.persona_id AND r.next_t = w.t_index - 1),
ev AS (SELECT persona_id, week, 'journal_entry_submitted' AS event_type, 'complete' AS status, before AS parent_type FROM sub
  UNION ALL SELECT persona_id, week, 'nudge_suppression_checked', 'complete', 'journal_entry_submitted' FROM sub
  UNION ALL SELECT persona_id, week, 'nudge_decided', CASE WHEN event_id % 25 = 3 THEN 'failed' WHEN event_id % 10 = 4 THEN 'refused' ELSE 'complete' END, 'nudge_suppression_checked' FROM sub
  UNION ALL SELECT persona_id, week, 'weekly_review_requested', 'complete', 'nudge_decided' FROM reviewed
  UNION ALL SELECT persona_id, week, 'weekly_review_completed', CASE WHEN day(week) % 5 = 0 THEN 'refused' ELSE 'complete' END, 'weekly_review_requested' FROM reviewed
  UNION ALL SELECT persona_id, week, 'drift_detected', 'complete', 'weekly_review_completed' FROM reviewed
  UNION ALL SELECT persona_id, week, 'weekly_digest_built', 'complete', 'drift_detected' FROM reviewed)
SELECT CAST(persona_id AS VARCHAR) AS session_id, week AS week_start, event_type, status, parent_type, count(*) AS n FROM ev GROUP BY ALL""", views=True)
def _(spark, sf):
    """Events of every session with the type of the event that each is linked to (the coach's status is in t07_live_drift)."""
    log = _log(spark, sf, False, "event")
    of = Window.partitionBy("session_id").orderBy("seq")
    linked = log.withColumn("parent_type", F.lag("event_type").over(of)).withColumn("_is_last", F.lag("event_id").over(of).eqNullSafe(F.col("parent_id")))
    parent = F.when(F.col("_is_last"), F.col("parent_type")).otherwise("elsewhere")
    rows = linked.where("event_type <> 'weekly_coach_generated'")
    return rows.groupBy("session_id", F.col("week_start").cast("date").alias("week_start"), "event_type", "status", parent.alias("parent_type")).agg(F.count(F.lit(1)).alias("n"))


def _standing(gone: str) -> str:
    """The decisions of reviewed weeks on entries that are left, as trajectories."""
    values = ", ".join(f"({k}, '{v}')" for k, v in enumerate(VALUES))
    return f"""WITH RECURSIVE {WEEKS},
standing AS (SELECT persona_id, event_id, t_index, d, week, dim AS dimension, CASE WHEN day(week) % 5 = 0 OR x >= 6 THEN 'abstain' WHEN x < 4 THEN 'conflict' ELSE 'not_conflict' END AS verdict, CASE WHEN day(week) % 5 = 0 THEN 'refusal' ELSE 'ok' END AS review_status
  FROM (SELECT w.persona_id, w.event_id, w.t_index, w.d, w.week, v.dim, (w.event_id * 11 + v.place * 7) % 10 AS x FROM wk w JOIN reviewed r ON r.persona_id = w.persona_id AND r.week = w.week CROSS JOIN (VALUES {values}) v(place, dim)) WHERE {gone})"""


@plans.add("t07_live_drift", _recursive(_standing("true") + ", " + MACHINE.strip().removeprefix("WITH RECURSIVE").strip().replace("FROM decision", "FROM standing") + """,
last AS (SELECT m.persona_id, s.week, m.dimension, arg_max(m.state, m.t_index) AS state FROM m JOIN standing s ON s.persona_id = m.persona_id AND s.dimension = m.dimension AND s.t_index = m.t_index GROUP BY ALL)
SELECT CAST(persona_id AS VARCHAR) AS session_id, week AS week_start, CASE WHEN bool_or(state = 'active_drift') THEN 'active_drift' WHEN bool_or(state = 'insufficient_evidence') THEN 'insufficient_evidence' ELSE 'no_active_drift' END AS drift,
  CASE WHEN bool_or(state = 'active_drift') THEN 'complete' ELSE 'failed' END AS coach FROM last GROUP BY 1, 2"""))
def _(spark, sf):
    """What each week's review found, and whether the coach answered."""
    log = _log(spark, sf, False, "event")
    one = lambda kind, column: F.max(F.when(F.col("event_type") == kind, F.col(column)))
    weeks = log.groupBy("session_id", F.col("week_start").cast("date").alias("week_start"))
    return weeks.agg(one("drift_detected", "verdict").alias("drift"), one("weekly_coach_generated", "status").alias("coach")).where("drift is not null")


@plans.add("t08_live_retraction", _recursive(_standing("event_id % 40 <> 7") + ", " + MACHINE.strip().removeprefix("WITH RECURSIVE").strip().replace("FROM decision", "FROM standing") + """
SELECT CAST(persona_id AS VARCHAR) AS session_id, dimension AS value, arg_max(state, t_index) AS state, max(t_index) AS t_index, count(*) AS n FROM m GROUP BY 1, 2"""))
def _(spark, sf):
    """After removals: the states that the log's changes fold to."""
    standing = live.standing_changes(live.changes(_log(spark, sf, True, "decision"))).withColumn("d", F.col("week_start"))
    rows = episodes.transitions(standing, ("session_id", "value"))
    return rows.groupBy("session_id", "value").agg(F.max_by("state", "t_index").alias("state"), F.max("t_index").alias("t_index"), F.count(F.lit(1)).alias("n"))


@plans.add("t08_live_changes", f"""WITH {WEEKS}, gone AS (SELECT persona_id, week, t_index, event_id FROM wk WHERE event_id % 40 = 7),
step AS (SELECT g.persona_id, r.week, g.event_id, (SELECT count(*) FROM wk e WHERE e.persona_id = g.persona_id AND e.week = r.week AND NOT EXISTS (SELECT 1 FROM gone b WHERE b.event_id = e.event_id AND b.t_index < g.t_index)) AS stood,
  (SELECT count(*) FROM wk e WHERE e.persona_id = g.persona_id AND e.week = r.week AND NOT EXISTS (SELECT 1 FROM gone b WHERE b.event_id = e.event_id AND b.t_index <= g.t_index)) AS after
  FROM gone g JOIN reviewed r ON r.persona_id = g.persona_id AND r.week >= g.week)
SELECT CAST(r.persona_id AS VARCHAR) AS session_id, r.week AS week_start, CAST({len(VALUES)} * ((SELECT count(*) FROM wk e WHERE e.persona_id = r.persona_id AND e.week = r.week) + coalesce(sum(s.after), 0)) AS BIGINT) AS made, CAST({len(VALUES)} * coalesce(sum(s.stood), 0) AS BIGINT) AS taken_back
FROM reviewed r LEFT JOIN step s ON s.persona_id = r.persona_id AND s.week = r.week GROUP BY r.persona_id, r.week""", views=True)
def _(spark, sf):
    """How many decisions of each week were made and taken back, over all removals in order."""
    log = live.changes(_log(spark, sf, True, "decision"))
    return log.groupBy("session_id", F.col("week_start").cast("date").alias("week_start")).agg(F.count_if(F.col("change") > 0).alias("made"), F.count_if(F.col("change") < 0).alias("taken_back"))


def _fake(request: dict) -> dict:
    """A judge that refuses some cases, fails on others, forgets an item of others and invents a verdict for the rest of a kind."""
    case = int(request["case"])
    if case % 7 == 1:
        raise judges.Refusal("declined")
    if case % 7 == 2:
        raise ConnectionError("no route")
    out = {x["id"]: ("conflict", "not_conflict", "abstain")[int(x["payload"]) % 3] for x in request["items"]}
    if case % 7 == 3:
        out.pop(min(out))
    return out | dict.fromkeys(out, "perhaps") if case % 7 == 4 else out


@plans.add("v15_injected_judge", """SELECT persona_id % 7 AS kind, CASE persona_id % 7 WHEN 1 THEN 'refusal' WHEN 2 THEN 'error' WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN persona_id % 7 BETWEEN 1 AND 4 THEN 'abstain' ELSE CASE event_id % 3 WHEN 0 THEN 'conflict' WHEN 1 THEN 'not_conflict' ELSE 'abstain' END END AS verdict, CASE WHEN persona_id % 7 = 2 THEN 2 ELSE 1 END AS attempts, count(*) AS n FROM entry GROUP BY ALL""", views=True)
def _(spark, sf):
    """Every entry judged by an injected function that fails in each way: nothing is lost, all failures abstain."""
    items = adapter.entry(spark, sf).select(F.col("persona_id").alias("case_id"), F.col("event_id").alias("item_id"), F.col("event_id").alias("payload"))
    out = judges.judged(items, _fake, attempts=2)
    return out.groupBy((F.col("case_id").cast("long") % 7).alias("kind"), "status", "verdict", "attempts").agg(F.count(F.lit(1)).alias("n"))
