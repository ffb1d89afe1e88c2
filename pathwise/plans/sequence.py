"""Trajectory queries: spans, pairs, episodes, state machine, detectors (survey rows W*, J9-J18, X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise import adapter
from pathwise.operators import detectors as det
from pathwise.operators import episodes as epi
from pathwise.operators import sequence as seq
from pathwise.plans.base import Plans

plans = Plans()
CORE = ("persona_id", "dimension")


def conflict():
    return F.coalesce(F.col("score") == -1, F.lit(False))


#: Islands of consecutive -1 labels, shared by several oracles.
ISLANDS = """
runs AS (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS run FROM label WHERE score = -1),
spans AS (SELECT persona_id, dimension, min(t_index) AS onset, max(t_index) AS "end", count(*) AS length FROM runs GROUP BY persona_id, dimension, run HAVING count(*) >= 2)
"""


@plans.add("w01_prior_entries", "SELECT persona_id, event_id, row_number() OVER (PARTITION BY persona_id ORDER BY t_index) - 1 AS n_before FROM entry", views=True)
def _(spark, sf):
    df = adapter.entry(spark, sf)
    return df.select("persona_id", "event_id", (F.row_number().over(seq.along(["persona_id"])) - 1).cast("long").alias("n_before"))


@plans.add("w02_pair_decisions", """
WITH pairs AS (SELECT persona_id, dimension, t_index, lead(t_index) OVER w AS n, p_minus1 AS p, lead(p_minus1) OVER w AS q, uncertainty AS u, lead(uncertainty) OVER w AS v
  FROM evidence WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
d AS (SELECT *, (p + q) / 2 AS mp, CASE WHEN u IS NOT NULL AND v IS NOT NULL THEN greatest(u, v) END AS mu FROM pairs WHERE n = t_index + 1)
SELECT persona_id, dimension, t_index AS window_start, n AS window_end, round(mp, 6) AS mean_probability, mu AS max_uncertainty,
  CASE WHEN mp IS NULL THEN 'missing_probability' WHEN mp < 0.6 THEN 'low_probability' WHEN mu IS NULL THEN 'missing_uncertainty' WHEN mu > 0.5 THEN 'high_uncertainty' ELSE 'alert' END AS reason FROM d""", views=True)
def _(spark, sf):
    return seq.detection_decisions(adapter.evidence(spark, sf), 0.6, 0.5).select(*CORE, "window_start", "window_end", F.round("mean_probability", 6).alias("mean_probability"), "max_uncertainty", "reason")


@plans.add("w03_drift_spans", f'WITH {ISLANDS} SELECT persona_id, dimension, onset, onset + 1 AS confirmation, "end", length FROM spans', views=True)
def _(spark, sf):
    return seq.drift_spans(adapter.label(spark, sf), conflict())


@plans.add("w04_runs_by_position", """
WITH placed AS (SELECT persona_id, dimension, t_index, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS i, p_minus1 >= 0.5 AS hit FROM evidence),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS run FROM placed WHERE hit)
SELECT persona_id, dimension, min(t_index) AS onset, max(t_index) AS "end", count(*) AS length FROM runs GROUP BY persona_id, dimension, run""", views=True)
def _(spark, sf):
    runs = seq.flagged_runs(adapter.evidence(spark, sf), F.coalesce(F.col("p_minus1") >= 0.5, F.lit(False)), by_position=True)
    return runs.groupBy(*CORE, "run").agg(F.min("t_index").alias("onset"), F.max("t_index").alias("end"), F.count(F.lit(1)).alias("length")).drop("run")


@plans.add("w05_longest_run", """
WITH p AS (SELECT persona_id, dimension, t_index, coalesce(score = 0, false) AS hit, row_number() OVER w AS i FROM label WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
r AS (SELECT persona_id, dimension, i - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM p WHERE hit),
n AS (SELECT persona_id, dimension, count(*) AS n FROM r GROUP BY persona_id, dimension, g)
SELECT k.persona_id, k.dimension, CAST(coalesce(max(n), 0) AS BIGINT) AS longest FROM (SELECT DISTINCT persona_id, dimension FROM label) k LEFT JOIN n USING (persona_id, dimension) GROUP BY k.persona_id, k.dimension""", views=True)
def _(spark, sf):
    return seq.longest_run(adapter.label(spark, sf), F.coalesce(F.col("score") == 0, F.lit(False)))


DIPS = """
WITH s AS (SELECT persona_id, dimension, t_index, score, is_core, lag(score) OVER w AS prev, lead(t_index) OVER w AS nxt,
  max(score) OVER (PARTITION BY persona_id, dimension ORDER BY t_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS best
  FROM label WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
dip AS (SELECT persona_id, dimension, t_index, is_core, prev - score AS severity, CASE WHEN nxt IS NOT NULL THEN coalesce(best >= 0, false) END AS recovered FROM s WHERE prev >= 0 AND score = -1)
"""


@plans.add("w06_dips", DIPS + "SELECT persona_id, dimension, t_index, severity, recovered FROM dip", views=True)
def _(spark, sf):
    return seq.dips(adapter.label(spark, sf))


@plans.add("w07_fades", """
WITH s AS (SELECT persona_id, dimension, t_index, score, lead(score, 1) OVER w AS a, lead(score, 2) OVER w AS b FROM label WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index))
SELECT persona_id, dimension, t_index FROM s WHERE score = 1 AND a = 0 AND b = 0""", views=True)
def _(spark, sf):
    return seq.fades(adapter.label(spark, sf), 2).select(*CORE, "t_index")


@plans.add("w08_recovery_share", DIPS + """SELECT dimension, count(recovered) AS n_dips, CAST(sum(CASE WHEN recovered THEN 1 ELSE 0 END) AS BIGINT) AS n_recovered,
  round(avg(CASE WHEN recovered THEN 1.0 WHEN NOT recovered THEN 0.0 END), 6) AS share FROM dip GROUP BY dimension""", views=True)
def _(spark, sf):
    d = seq.dips(adapter.label(spark, sf))
    return d.groupBy("dimension").agg(F.count("recovered").alias("n_dips"), F.count_if("recovered").alias("n_recovered"), F.round(F.avg(F.col("recovered").cast("double")), 6).alias("share"))


WEEKLY_MEANS = """
weeks AS (SELECT persona_id, dimension, CAST(date_trunc('week', d) AS DATE) AS week, avg(score) AS m, count(score) AS n FROM label WHERE score IS NOT NULL GROUP BY 1, 2, 3)
"""


def _weeks(spark, sf):
    df = adapter.label(spark, sf).where("score is not null")
    return df.groupBy(*CORE, F.date_trunc("week", "d").cast("date").alias("week")).agg(F.avg("score").alias("m"), F.count("score").alias("n"))


@plans.add("w09_weekly_drop", f"""
WITH {WEEKLY_MEANS}, s AS (SELECT *, lag(m) OVER (PARTITION BY persona_id, dimension ORDER BY week) AS before FROM weeks)
SELECT persona_id, dimension, week, round(before - m, 6) AS fall FROM s WHERE before - m >= 0.3 + 1e-9""", views=True)
def _(spark, sf):
    fall = F.lag("m").over(seq.along(CORE, "week")) - F.col("m")
    return _weeks(spark, sf).withColumn("fall", fall).where(F.col("fall") >= 0.3 + 1e-9).select(*CORE, "week", F.round("fall", 6).alias("fall"))


@plans.add("w10_low_weeks", f"""
WITH {WEEKLY_MEANS}, s AS (SELECT *, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY week) AS i FROM weeks),
r AS (SELECT *, i - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY week) AS g FROM s WHERE m < 0)
SELECT persona_id, dimension, min(week) AS from_week, max(week) AS to_week, count(*) AS n_weeks FROM r GROUP BY persona_id, dimension, g HAVING count(*) >= 2""", views=True)
def _(spark, sf):
    placed = _weeks(spark, sf).withColumn("i", F.row_number().over(seq.along(CORE, "week")))
    runs = placed.where("m < 0").withColumn("g", F.col("i") - F.row_number().over(seq.along(CORE, "week")))
    return runs.groupBy(*CORE, "g").agg(F.min("week").alias("from_week"), F.max("week").alias("to_week"), F.count(F.lit(1)).alias("n_weeks")).where("n_weeks >= 2").drop("g")


@plans.add("w11_week_bins", """SELECT persona_id, event_id, CAST(date_trunc('week', d) AS DATE) AS calendar_week,
  CAST(floor(date_diff('day', min(d) OVER (PARTITION BY persona_id), d) / 7) AS BIGINT) AS anchored_week FROM entry""", views=True)
def _(spark, sf):
    first = F.min("d").over(seq.Window.partitionBy("persona_id"))
    return adapter.entry(spark, sf).select("persona_id", "event_id", F.date_trunc("week", "d").cast("date").alias("calendar_week"), F.floor(F.datediff("d", first) / 7).alias("anchored_week"))


@plans.add("w12_three_rules", """
WITH s AS (SELECT persona_id, dimension, t_index, d, score, lag(score) OVER w AS a, lag(score, 2) OVER w AS b, lag(t_index) OVER w AS ta FROM label WHERE is_core WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
wk AS (SELECT persona_id, dimension, date_trunc('week', d) AS week, count(*) AS n FROM s WHERE score = -1 GROUP BY 1, 2, 3),
r AS (SELECT persona_id, bool_or(coalesce(score = -1 AND a = -1 AND ta = t_index - 1, false)) AS consecutive, bool_or(coalesce(score = -1 AND (a = -1 OR b = -1), false)) AS two_of_three FROM s GROUP BY persona_id)
SELECT r.persona_id, consecutive, coalesce(q.same_week, false) AS same_week, two_of_three, consecutive OR coalesce(q.same_week, false) OR two_of_three AS any_rule
FROM r LEFT JOIN (SELECT persona_id, bool_or(n >= 2) AS same_week FROM wk GROUP BY persona_id) q USING (persona_id)""", views=True)
def _(spark, sf):
    w = seq.along(CORE)
    week = seq.Window.partitionBy(*CORE, F.date_trunc("week", "d"))
    s, no = F.col("score"), F.lit(False)
    rows = adapter.label(spark, sf).where("is_core").withColumns({
        "r1": F.coalesce((s == -1) & (F.lag(s).over(w) == -1) & (F.lag("t_index").over(w) == F.col("t_index") - 1), no),
        "r2": F.count_if(s == -1).over(week) >= 2, "r3": F.coalesce((s == -1) & ((F.lag(s).over(w) == -1) | (F.lag(s, 2).over(w) == -1)), no)})
    out = rows.groupBy("persona_id").agg(F.bool_or("r1").alias("consecutive"), F.bool_or("r2").alias("same_week"), F.bool_or("r3").alias("two_of_three"))
    return out.withColumn("any_rule", F.col("consecutive") | F.col("same_week") | F.col("two_of_three"))


#: The reviewer's machine as a recursion over rows, the plain form of the rules.
MACHINE = """
WITH RECURSIVE
o AS (SELECT *, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS i, lag(t_index) OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS before FROM decision),
m AS (
  SELECT persona_id, dimension, t_index, i, false AS gap,
    CASE WHEN review_status <> 'ok' THEN 'insufficient_evidence' ELSE 'no_active_drift' END AS state, CASE WHEN review_status = 'ok' AND verdict = 'conflict' THEN 1 ELSE 0 END AS run,
    review_status <> 'ok' AS unresolved, verdict, CASE WHEN review_status <> 'ok' THEN 'insufficient' WHEN verdict = 'conflict' THEN 'start' ELSE 'reset' END AS effect FROM o WHERE i = 1
  UNION ALL
  SELECT persona_id, dimension, t_index, i, g,
    CASE WHEN bad THEN 'insufficient_evidence' WHEN v = 'not_conflict' THEN 'no_active_drift' WHEN v = 'abstain' THEN CASE WHEN live THEN 'insufficient_evidence' ELSE 'no_active_drift' END
         WHEN again THEN 'active_drift' WHEN unres THEN 'insufficient_evidence' ELSE 'no_active_drift' END,
    CASE WHEN bad OR v <> 'conflict' THEN 0 WHEN again THEN prun + 1 ELSE 1 END,
    CASE WHEN bad THEN true WHEN v = 'not_conflict' THEN false WHEN v = 'abstain' THEN live WHEN again THEN false ELSE unres END, v,
    CASE WHEN bad THEN 'insufficient' WHEN v = 'not_conflict' THEN CASE WHEN live THEN 'end' ELSE 'reset' END WHEN v = 'abstain' THEN CASE WHEN live THEN 'insufficient' ELSE 'reset' END
         WHEN again THEN CASE WHEN prun = 1 THEN 'confirm' ELSE 'extend' END ELSE 'start' END
  FROM (SELECT o.persona_id, o.dimension, o.t_index, o.i, o.verdict AS v, o.review_status <> 'ok' AS bad, o.t_index <> o.before + 1 AS g,
          m.run > 0 OR m.state <> 'no_active_drift' AS live, m.unresolved OR (o.t_index <> o.before + 1 AND (m.run > 0 OR m.state <> 'no_active_drift')) AS unres,
          o.t_index = o.before + 1 AND m.verdict = 'conflict' AND m.run > 0 AS again, m.run AS prun
        FROM m JOIN o ON o.persona_id = m.persona_id AND o.dimension = m.dimension AND o.i = m.i + 1))
"""


def _recursive(sql: str) -> str:
    """The views in front of a recursive query."""
    return adapter.VIEWS.replace("WITH entry", "WITH RECURSIVE entry", 1) + ", " + sql.strip().removeprefix("WITH RECURSIVE").strip()


@plans.add("w26_state_machine", _recursive(MACHINE + "SELECT persona_id, dimension, t_index, state, CAST(run AS BIGINT) AS run_length, gap AS gap_before, effect FROM m"))
def _(spark, sf):
    return epi.transitions(adapter.decision(spark, sf)).select(*CORE, "t_index", "state", "run_length", "gap_before", "effect")


@plans.add("w27_historical_drifts", """
WITH o AS (SELECT *, lead(t_index) OVER w AS nt, lead(verdict) OVER w AS nv FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
r AS (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM o WHERE verdict = 'conflict' AND review_status = 'ok'),
s AS (SELECT persona_id, dimension, min(t_index) AS onset, max(t_index) AS e, count(*) AS length, arg_max(nt, t_index) AS nt0, max(nt) AS nt, arg_max(nv, t_index) AS nv FROM r GROUP BY persona_id, dimension, g HAVING count(*) >= 2),
f AS (SELECT s.*, o.nt AS t2, o.nv AS v2 FROM s JOIN o ON o.persona_id = s.persona_id AND o.dimension = s.dimension AND o.t_index = s.e)
SELECT persona_id, dimension, onset, onset + 1 AS confirmation, e AS "end", length,
  CASE WHEN t2 IS NULL THEN NULL WHEN t2 <> e + 1 THEN 'gap' WHEN v2 = 'not_conflict' THEN 'not_conflict' ELSE 'abstain' END AS termination_reason,
  CASE WHEN t2 = e + 1 THEN t2 END AS termination_t_index FROM f""", views=True)
def _(spark, sf):
    return seq.historical_drifts(adapter.decision(spark, sf))


@plans.add("w28_detect_drift", _recursive(MACHINE + """
, last AS (SELECT *, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index DESC) AS r FROM m)
SELECT l.persona_id, CASE max(CASE state WHEN 'active_drift' THEN 2 WHEN 'insufficient_evidence' THEN 1 ELSE 0 END) WHEN 2 THEN 'active_drift' WHEN 1 THEN 'insufficient_evidence' ELSE 'no_active_drift' END AS delivery_state,
  max(l.t_index) AS cutoff_t_index, max(x.d) AS cutoff_d, count(*) FILTER (WHERE state = 'active_drift') AS n_active
FROM last l JOIN decision x ON x.persona_id = l.persona_id AND x.dimension = l.dimension AND x.t_index = l.t_index WHERE l.r = 1 GROUP BY l.persona_id"""))
def _(spark, sf):
    return epi.delivery(adapter.decision(spark, sf))


@plans.add("w29_coverage", """
WITH s AS (SELECT persona_id, dimension, t_index, CASE verdict WHEN 'conflict' THEN true WHEN 'not_conflict' THEN false END AS a,
  lead(CASE verdict WHEN 'conflict' THEN true WHEN 'not_conflict' THEN false END) OVER w AS b, lead(t_index) OVER w AS n FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
g AS (SELECT persona_id, dimension, count(*) FILTER (WHERE n = t_index + 1) AS pairs, count(*) FILTER (WHERE n = t_index + 1 AND a AND b) AS both_true, count(*) FILTER (WHERE n = t_index + 1 AND (a = false OR b = false)) AS some_false FROM s GROUP BY ALL)
SELECT persona_id, dimension, both_true > 0 OR (pairs > 0 AND some_false = pairs) AS covered FROM g""", views=True)
def _(spark, sf):
    label = F.when(F.col("verdict") == "conflict", True).when(F.col("verdict") == "not_conflict", False)
    return seq.coverage(adapter.decision(spark, sf).withColumn("label", label))


REFERENCE = """
WITH l AS (SELECT *, lead(t_index) OVER w AS nt, lead(score) OVER w AS ns, lead(confidence) OVER w AS nc FROM label WHERE is_core WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
rr AS (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS run FROM l WHERE score = -1),
sp AS (SELECT persona_id, dimension, min(t_index) AS onset_t_index, max(t_index) AS end_t_index, min(d) AS onset_date, max(d) AS end_date, count(*) AS length, avg(agreement) AS mean_agreement,
  string_agg(CAST(t_index AS VARCHAR), ',' ORDER BY t_index) AS supporting FROM rr GROUP BY persona_id, dimension, run HAVING count(*) >= 2),
ref AS (SELECT 'label::' || sp.persona_id || '::' || sp.dimension || '::' || onset_t_index AS episode_id, sp.*, onset_t_index + 1 AS confirmation_t_index, nt IS NULL AS open_at_cutoff, nt AS termination_t_index, ns AS termination_label,
  CASE WHEN nt IS NULL THEN 'active' WHEN nt <> end_t_index + 1 OR ns IS NULL OR nc = 'no_majority' THEN 'uncertain' ELSE 'recovered' END AS delivery_state
  FROM sp JOIN l ON l.persona_id = sp.persona_id AND l.dimension = sp.dimension AND l.t_index = sp.end_t_index)
"""


def _reference(spark, sf):
    return seq.reference_episodes(adapter.label(spark, sf).where("is_core"))


@plans.add("w30_reference_episodes", REFERENCE + """SELECT episode_id, persona_id, dimension, onset_t_index, confirmation_t_index, end_t_index, onset_date, end_date, length, open_at_cutoff, delivery_state,
  termination_t_index, termination_label, supporting, round(mean_agreement, 6) AS mean_agreement FROM ref""", views=True)
def _(spark, sf):
    return _reference(spark, sf).withColumn("mean_agreement", F.round("mean_agreement", 6))


PREDICTED = """
WITH e AS (SELECT *, lead(t_index) OVER w AS nt, lead(p_minus1) OVER w AS np, lead(uncertainty) OVER w AS nu, lead(predicted_class) OVER w AS nc FROM evidence WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
al AS (SELECT persona_id, dimension, t_index, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM e
  WHERE nt = t_index + 1 AND (p_minus1 + np) / 2 >= 0.55 AND uncertainty <= 0.5 AND nu <= 0.5),
ch AS (SELECT persona_id, dimension, min(t_index) AS onset_t_index, max(t_index) + 1 AS end_t_index FROM al GROUP BY persona_id, dimension, g),
pred AS (SELECT 'soft::' || c.persona_id || '::' || c.dimension || '::' || onset_t_index AS episode_id, c.persona_id, c.dimension, onset_t_index, onset_t_index + 1 AS confirmation_t_index, end_t_index,
  count(*) AS length, avg(e.p_minus1) AS mean_conflict_evidence, avg(e.uncertainty) AS mean_uncertainty, any_value(CASE WHEN f.nt = f.t_index + 1 THEN false ELSE true END) AS open_at_cutoff,
  any_value(CASE WHEN f.nt IS NULL OR f.nt <> f.t_index + 1 THEN 'active' WHEN f.np IS NULL OR f.nc IS NULL OR f.nu IS NULL OR f.nu > 0.5 THEN 'uncertain' WHEN f.nc = -1 THEN 'active' ELSE 'recovered' END) AS delivery_state
  FROM ch c JOIN e ON e.persona_id = c.persona_id AND e.dimension = c.dimension AND e.t_index BETWEEN onset_t_index AND end_t_index
  JOIN e f ON f.persona_id = c.persona_id AND f.dimension = c.dimension AND f.t_index = end_t_index GROUP BY c.persona_id, c.dimension, onset_t_index, end_t_index)
"""


@plans.add("w31_predicted_episodes", PREDICTED + """SELECT episode_id, persona_id, dimension, onset_t_index, confirmation_t_index, end_t_index, length, open_at_cutoff, delivery_state,
  round(mean_conflict_evidence, 6) AS mean_conflict_evidence, round(mean_uncertainty, 6) AS mean_uncertainty FROM pred""", views=True)
def _(spark, sf):
    out = seq.predicted_episodes(adapter.evidence(spark, sf), 0.55, 0.5)
    return out.drop("source").withColumns({c: F.round(c, 6) for c in ("mean_conflict_evidence", "mean_uncertainty")})


@plans.add("w32_unresolved_pairs", """
WITH s AS (SELECT persona_id, dimension, t_index, verdict AS a, lead(verdict) OVER w AS b, lead(t_index) OVER w AS n FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index))
SELECT persona_id, dimension, t_index FROM s WHERE n = t_index + 1 AND (a = 'abstain' OR b = 'abstain') AND a <> 'not_conflict' AND b <> 'not_conflict'""", views=True)
def _(spark, sf):
    return seq.unresolved_pairs(adapter.decision(spark, sf)).select(*CORE, "t_index")


@plans.add("w33_case_outcomes", """
WITH n AS (SELECT persona_id, dimension, bool_or(score IS NULL) AS unresolved FROM label GROUP BY ALL),
r AS (SELECT persona_id, dimension, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM label WHERE score = -1),
s AS (SELECT persona_id, dimension, max(c) AS longest FROM (SELECT persona_id, dimension, count(*) AS c FROM r GROUP BY persona_id, dimension, g) GROUP BY ALL)
SELECT n.persona_id, n.dimension, CASE WHEN unresolved THEN 'unresolved' WHEN coalesce(longest, 0) >= 2 THEN 'sustained' ELSE 'none' END AS outcome FROM n LEFT JOIN s ON s.persona_id = n.persona_id AND s.dimension = n.dimension""", views=True)
def _(spark, sf):
    df = adapter.label(spark, sf)
    s, w = F.col("score"), seq.along(CORE)
    rows = df.withColumn("_pair", F.coalesce((s == -1) & (F.lag(s).over(w) == -1), F.lit(False)))
    outcome = F.when(F.bool_or(s.isNull()), "unresolved").when(F.bool_or("_pair"), "sustained").otherwise("none")
    return rows.groupBy(*CORE).agg(outcome.alias("outcome"))


@plans.add("w34_history_by_position", """SELECT persona_id, dimension, t_index, coalesce(lag(p_minus1, 1) OVER w, 0) AS before_1_p_minus1, coalesce(lag(p_minus1, 2) OVER w, 0) AS before_2_p_minus1
  FROM evidence WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)""", views=True)
def _(spark, sf):
    return seq.history_rows(adapter.evidence(spark, sf), ["p_minus1"], 2).select(*CORE, "t_index", "before_1_p_minus1", "before_2_p_minus1")


@plans.add("w35_history_by_index", """WITH h AS MATERIALIZED (SELECT persona_id, dimension, t_index, t_index - lag(t_index, 1) OVER w AS g1, lag(p_minus1, 1) OVER w AS p1, t_index - lag(t_index, 2) OVER w AS g2, lag(p_minus1, 2) OVER w AS p2
  FROM evidence WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index))
SELECT persona_id, dimension, t_index, coalesce(CASE WHEN g1 = 1 THEN p1 END, 0) AS before_1_p_minus1, coalesce(CASE WHEN g1 = 2 THEN p1 WHEN g2 = 2 THEN p2 END, 0) AS before_2_p_minus1 FROM h ORDER BY ALL""", views=True)
def _(spark, sf):
    return seq.history_rows(adapter.evidence(spark, sf), ["p_minus1"], 2, by_index=True).select(*CORE, "t_index", "before_1_p_minus1", "before_2_p_minus1")


@plans.add("w36_day_gaps", """SELECT persona_id, event_id, round(coalesce(greatest(0, least(30, date_diff('day', lag(d) OVER w, d))), 7) / 30.0, 6) AS day_gap FROM entry WINDOW w AS (PARTITION BY persona_id ORDER BY t_index)""", views=True)
def _(spark, sf):
    return seq.day_gaps(adapter.entry(spark, sf)).select("persona_id", "event_id", F.round("day_gap", 6).alias("day_gap"))


@plans.add("w38_moving_average", """
WITH s AS (SELECT persona_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY persona_id) AS n, sum(value) OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s,
  first_value(value) OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f, last_value(value) OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
  FROM entry WINDOW w AS (PARTITION BY persona_id ORDER BY t_index))
SELECT persona_id, event_id, round((s + greatest(0, 3 - i) * f + greatest(0, 2 - (n - i)) * l) / 5, 6) AS smoothed FROM s""", views=True)
def _(spark, sf):
    return seq.moving_average(adapter.entry(spark, sf), "value", ["persona_id"], "t_index", 5).select("persona_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@plans.add("w39_suppression", """SELECT persona_id, event_id, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 2, false) AS suppress FROM entry""", views=True)
def _(spark, sf):
    df = adapter.entry(spark, sf).withColumn("shown", F.col("event_type") == "click")
    return seq.sliding_suppression(df, "shown", ["persona_id"], "t_index").select("persona_id", "event_id", "suppress")


@plans.add("w40_date_sequence", """SELECT persona_id, event_id, DATE '2024-01-01' + CAST(sum(1 + k % 5) OVER (PARTITION BY persona_id ORDER BY t_index) AS INTEGER) AS day FROM entry""", views=True)
def _(spark, sf):
    gap = F.sum(1 + F.col("k") % 5).over(seq.along(["persona_id"]).rowsBetween(*det.UP_TO)).cast("int")
    return adapter.entry(spark, sf).select("persona_id", "event_id", F.date_add(F.lit("2024-01-01").cast("date"), gap).alias("day"))


SIGNAL = """
sig AS (SELECT persona_id, dimension, t_index, is_core, 1.0 - 2.0 * CAST((event_id * 37 + dim_index * 11) % 101 AS DOUBLE) / 100 AS score, CASE WHEN is_core THEN 0.5 ELSE 0.0 END AS weight FROM label),
pos AS (SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY persona_id, dimension) AS n FROM sig WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
sc AS (SELECT *, greatest(2, least(4, n // 3)) AS warmup, CAST(weight AS DOUBLE) * greatest(0.0, -score) AS s FROM pos)
"""


def _signal(spark, sf):
    """Scores between -1 and 1 for every dimension, with weight 1/2 on the declared ones."""
    score = F.lit(1.0) - F.lit(2.0) * ((F.col("event_id") * 37 + F.col("dim_index") * 11) % 101).cast("double") / 100
    rows = adapter.label(spark, sf).select(*CORE, "t_index", "is_core", score.alias("score"), F.when(F.col("is_core"), 0.5).otherwise(0.0).alias("weight"))
    return det.positions(rows)


@plans.add("w16_crash_or_rut", f"""WITH {SIGNAL},
a AS (SELECT *, lag(score) OVER w AS prev, score < -0.4 AND position >= 1 AS low, sum(CASE WHEN score < -0.4 AND position >= 1 THEN 0 ELSE 1 END) OVER w AS g FROM sc WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
b AS (SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY persona_id, dimension, g ORDER BY t_index) AS nth FROM a)
SELECT persona_id, dimension, t_index FROM b WHERE weight >= 0.15 AND ((prev >= 0 AND score < 0) OR (low AND nth = 3))""", views=True)
def _(spark, sf):
    return det.crash_or_rut(_signal(spark, sf))


@plans.add("w17_ema", f"""WITH {SIGNAL}
SELECT a.persona_id, a.dimension, a.t_index FROM sc a JOIN sc b ON b.persona_id = a.persona_id AND b.dimension = a.dimension AND b.position <= a.position AND b.position > a.position - 110
WHERE a.weight > 0 GROUP BY ALL HAVING sum(0.3 * pow(0.7, a.position - b.position) * b.s) > 0.10""", views=True)
def _(spark, sf):
    return det.ema(_signal(spark, sf))


@plans.add("w18_cusum", f"""WITH {SIGNAL},
c AS (SELECT *, sum(s - 0.2) OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS c FROM sc), f AS (SELECT *, min(c) OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS low FROM c)
SELECT persona_id, dimension, t_index FROM f WHERE c - least(0.0, low) > 0.500001""", views=True)
def _(spark, sf):
    return det.cusum(_signal(spark, sf), slack=0.2, above=0.500001)


@plans.add("w19_cosine", f"""WITH {SIGNAL},
g AS (SELECT persona_id, t_index, sum(score * weight) AS dot, sqrt(sum(score * score)) AS a, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS b FROM sc GROUP BY ALL)
SELECT persona_id, t_index, round(dot / (a * b), 6) AS cosine FROM g WHERE a > 1e-8 AND b > 1e-8 AND dot / (a * b) < -0.0000001""", views=True)
def _(spark, sf):
    return det.cosine(_signal(spark, sf), below=-1e-7).withColumn("cosine", F.round("cosine", 6))


@plans.add("w20_control_chart", f"""WITH {SIGNAL},
m AS (SELECT persona_id, dimension, avg(score) AS m, stddev_pop(score) AS sd FROM sc WHERE position < warmup GROUP BY ALL)
SELECT sc.persona_id, sc.dimension, t_index FROM sc JOIN m ON m.persona_id = sc.persona_id AND m.dimension = sc.dimension WHERE position >= warmup AND score < m - 2 * sd - 1e-9""", views=True)
def _(spark, sf):
    return det.control_chart(_signal(spark, sf))


@plans.add("w21_kl", f"""WITH {SIGNAL},
b AS (SELECT persona_id, dimension, count(*) FILTER (WHERE score < -0.5) + 0.05 AS bn, count(*) FILTER (WHERE score BETWEEN -0.5 AND 0.5) + 0.05 AS bz, count(*) FILTER (WHERE score > 0.5) + 0.05 AS bp FROM sc WHERE position < warmup GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN score < -0.5 THEN 1.0 ELSE 0 END) OVER w + 0.05 AS rn, sum(CASE WHEN score BETWEEN -0.5 AND 0.5 THEN 1.0 ELSE 0 END) OVER w + 0.05 AS rz, sum(CASE WHEN score > 0.5 THEN 1.0 ELSE 0 END) OVER w + 0.05 AS rp
  FROM sc WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
q AS (SELECT r.persona_id, r.dimension, t_index, position, warmup, CAST(rn AS DOUBLE) / (rn + rz + rp) AS a1, CAST(rz AS DOUBLE) / (rn + rz + rp) AS a2, CAST(rp AS DOUBLE) / (rn + rz + rp) AS a3, CAST(bn AS DOUBLE) / (bn + bz + bp) AS b1, CAST(bz AS DOUBLE) / (bn + bz + bp) AS b2, CAST(bp AS DOUBLE) / (bn + bz + bp) AS b3
  FROM r JOIN b ON b.persona_id = r.persona_id AND b.dimension = r.dimension)
SELECT persona_id, dimension, t_index FROM q WHERE position >= warmup + 3 AND a1 * ln(a1 / b1) + a2 * ln(a2 / b2) + a3 * ln(a3 / b3) > 0.15""", views=True)
def _(spark, sf):
    return det.kl_divergence(_signal(spark, sf))


def _alerts(name: str) -> str:
    """The alerts of a detector's oracle as rows of the votes' union."""
    return f"SELECT persona_id, dimension, t_index, '{name}' AS detector FROM ({plans.oracles[name]})"


@plans.add("w22_detector_votes", """WITH u AS (""" + " UNION ALL ".join(map(_alerts, ("w16_crash_or_rut", "w17_ema", "w18_cusum", "w20_control_chart", "w21_kl"))) + f"""
  UNION ALL SELECT c.persona_id, l.dimension, c.t_index, 'w19_cosine' FROM ({plans.oracles["w19_cosine"]}) c JOIN label l ON l.persona_id = c.persona_id AND l.t_index = c.t_index),
own AS (SELECT DISTINCT persona_id, dimension FROM label WHERE is_core),
n AS (SELECT u.persona_id, u.dimension, t_index, count(DISTINCT detector) AS n_detectors FROM u JOIN own ON own.persona_id = u.persona_id AND own.dimension = u.dimension GROUP BY ALL)
SELECT *, CASE WHEN n_detectors >= 4 THEN 'strong' WHEN n_detectors >= 2 THEN 'weak' ELSE 'single' END AS band FROM n""", views=True)
def detector_votes(spark, sf):
    rows = _signal(spark, sf)
    core = rows.where("is_core")
    vector = det.cosine(rows, below=-1e-7).select("persona_id", "t_index").join(core.select(*CORE, "t_index"), ["persona_id", "t_index"])
    control = det.control_chart(core)
    return det.votes({"crash_or_rut": det.crash_or_rut(core), "ema": det.ema(core), "cusum": det.cusum(core, slack=0.2, above=0.500001), "cosine": vector, "control": control, "kl": det.kl_divergence(core)})


@plans.add("w23_detector_scores", f"""WITH {SIGNAL},
m AS (SELECT persona_id, dimension, avg(score) AS m, stddev_pop(score) AS sd FROM sc WHERE position < warmup GROUP BY ALL),
x AS (SELECT position >= warmup AND score < m - 2 * sd - 1e-9 AS a, score < -0.5 AS t FROM sc JOIN m ON m.persona_id = sc.persona_id AND m.dimension = sc.dimension),
c AS (SELECT count(*) FILTER (WHERE a AND t) AS hits, count(*) FILTER (WHERE a AND NOT t) AS false_alerts, count(*) FILTER (WHERE NOT a AND t) AS misses, count(*) FILTER (WHERE NOT a AND NOT t) AS quiet FROM x)
SELECT *, round(hits / (hits + false_alerts), 6) AS precision, round(hits / (hits + misses), 6) AS recall, round(false_alerts / (false_alerts + quiet), 6) AS false_alert_rate FROM c""", views=True)
def _(spark, sf):
    rows = _signal(spark, sf)
    out = det.score_alerts(rows, det.control_chart(rows), F.col("score") < -0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_alert_rate")})


def _predicted(spark, sf):
    return seq.predicted_episodes(adapter.evidence(spark, sf), 0.55, 0.5)


#: Greedy one-to-one matching of `ref` and `pred`, reference by reference: what is used is carried along.
GREEDY = """
rs AS (SELECT persona_id, dimension, list({'id': episode_id, 'conf': confirmation_t_index, 'onset': onset_t_index, 'until': end_t_index + 2, 'state': delivery_state} ORDER BY confirmation_t_index, episode_id) AS refs FROM ref GROUP BY 1, 2),
ps AS (SELECT persona_id, dimension, list({'id': episode_id, 'conf': confirmation_t_index, 'state': delivery_state} ORDER BY confirmation_t_index, episode_id) AS preds FROM pred GROUP BY 1, 2),
both_ AS (SELECT rs.*, preds FROM rs JOIN ps ON ps.persona_id = rs.persona_id AND ps.dimension = rs.dimension),
greedy AS (
  SELECT persona_id, dimension, 0 AS i, CAST([] AS VARCHAR[]) AS used, NULL::STRUCT(id VARCHAR, conf BIGINT, state VARCHAR) AS hit FROM both_
  UNION ALL
  SELECT persona_id, dimension, i + 1, CASE WHEN h IS NULL THEN used ELSE list_append(used, h.id) END, h FROM (
    SELECT g.persona_id, g.dimension, g.i, g.used, list_filter(b.preds, lambda p: p.conf >= b.refs[g.i + 1].onset AND p.conf <= b.refs[g.i + 1].until AND NOT list_contains(g.used, p.id))[1] AS h
    FROM greedy g JOIN both_ b ON b.persona_id = g.persona_id AND b.dimension = g.dimension WHERE g.i < len(b.refs))),
matched AS (SELECT g.persona_id, g.dimension, b.refs[g.i].id AS reference_episode_id, g.hit.id AS predicted_episode_id, b.refs[g.i].conf AS reference_confirmation, g.hit.conf AS predicted_confirmation,
  g.hit.conf - b.refs[g.i].conf AS latency_entries, b.refs[g.i].state AS reference_state, g.hit.state AS predicted_state FROM greedy g JOIN both_ b ON b.persona_id = g.persona_id AND b.dimension = g.dimension WHERE g.hit IS NOT NULL)
"""
MATCHES = "WITH RECURSIVE " + REFERENCE.strip().removeprefix("WITH").strip() + ", " + PREDICTED.strip().removeprefix("WITH").strip() + "," + GREEDY


@plans.add("j09_match_episodes", _recursive(MATCHES + "SELECT * FROM matched"))
def match(spark, sf):
    return epi.match_episodes(_reference(spark, sf), _predicted(spark, sf))


@plans.add("j11_inside_reference", REFERENCE + """
SELECT p.persona_id, p.dimension, p.t_index, EXISTS (SELECT 1 FROM ref r WHERE r.persona_id = p.persona_id AND r.dimension = p.dimension AND p.t_index BETWEEN r.onset_t_index AND r.end_t_index) AS inside FROM evidence p""", views=True)
def _(spark, sf):
    points = adapter.evidence(spark, sf).select(*CORE, "t_index")
    return epi.inside_reference(points.withColumn("at", F.col("t_index")), _reference(spark, sf), "at").select(*CORE, "t_index", "inside")


@plans.add("j12_prior_context", """SELECT persona_id, t_index, coalesce(string_agg(event_type, '>') OVER (PARTITION BY persona_id ORDER BY t_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM entry""", views=True)
def _(spark, sf):
    before = F.collect_list("event_type").over(seq.along(["persona_id"]).rowsBetween(-3, -1))
    return adapter.entry(spark, sf).select("persona_id", "t_index", F.concat_ws(">", before).alias("context"))


@plans.add("j18_next_row", """SELECT persona_id, dimension, t_index, lead(t_index) OVER w AS next_t_index, lead(verdict) OVER w AS next_verdict FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)""", views=True)
def _(spark, sf):
    w = seq.along(CORE)
    return adapter.decision(spark, sf).select(*CORE, "t_index", F.lead("t_index").over(w).alias("next_t_index"), F.lead("verdict").over(w).alias("next_verdict"))


@plans.add("j19_state_at_cutoff", _recursive(MACHINE + """
, dated AS (SELECT m.*, x.d FROM m JOIN decision x ON x.persona_id = m.persona_id AND x.dimension = m.dimension AND x.t_index = m.t_index),
lasts AS (SELECT *, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index DESC) AS r FROM dated WHERE d <= DATE '2024-01-17')
SELECT persona_id, dimension, t_index, state FROM lasts WHERE r = 1"""))
def _(spark, sf):
    rows = epi.transitions(adapter.decision(spark, sf)).where(F.col("d") <= F.lit("2024-01-17").cast("date"))
    return rows.groupBy(*CORE).agg(F.max("t_index").alias("t_index"), F.max_by("state", "t_index").alias("state"))


@plans.add("m16_episode_metrics", _recursive(MATCHES + """, k AS (SELECT persona_id, dimension, count(*) AS n FROM evidence GROUP BY 1, 2 HAVING count(*) >= 2),
neg AS (SELECT k.persona_id, k.dimension, EXISTS (SELECT 1 FROM pred p WHERE p.persona_id = k.persona_id AND p.dimension = k.dimension) AS hit FROM k WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.persona_id = k.persona_id AND r.dimension = k.dimension)),
pairs AS (SELECT persona_id, dimension, nt AS window_end, coalesce((p_minus1 + np) / 2 >= 0.55 AND uncertainty <= 0.5 AND nu <= 0.5, false) AS alert FROM e WHERE nt = t_index + 1),
win AS (SELECT alert FROM pairs w WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.persona_id = w.persona_id AND r.dimension = w.dimension AND w.window_end BETWEEN r.onset_t_index AND r.end_t_index)),
a AS (SELECT count(*) AS true_positive, avg(latency_entries) AS mean_latency, max(latency_entries) AS max_latency, median(latency_entries) AS median_latency, count(*) FILTER (WHERE reference_state = predicted_state) AS delivery_correct,
  count(*) FILTER (WHERE reference_state = 'recovered') AS recovery_cases, count(*) FILTER (WHERE reference_state = 'recovered' AND predicted_state = 'recovered') AS recovery_correct FROM matched),
b AS (SELECT *, (SELECT count(*) FROM ref) AS reference_episodes, (SELECT count(*) FROM pred) AS predicted_episodes, (SELECT count(*) FROM neg) AS negative_trajectories, (SELECT count(*) FROM neg WHERE hit) AS false_alarm_trajectories,
  (SELECT count(*) FROM win) AS negative_windows, (SELECT count(*) FROM win WHERE alert) AS alerted_windows FROM a),
c AS (SELECT *, coalesce(true_positive / nullif(predicted_episodes, 0), 0) AS precision, coalesce(true_positive / nullif(reference_episodes, 0), 0) AS recall FROM b)
SELECT * REPLACE (round(mean_latency, 6) AS mean_latency, round(precision, 6) AS precision, round(recall, 6) AS recall), round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(coalesce(false_alarm_trajectories / nullif(negative_trajectories, 0), 0), 6) AS trajectory_false_alarm_rate,
  round(alerted_windows / nullif(negative_windows, 0), 6) AS false_positive_rate, round(delivery_correct / nullif(true_positive, 0), 6) AS delivery_accuracy, round(recovery_correct / nullif(recovery_cases, 0), 6) AS recovery_accuracy FROM c"""))
def metrics(spark, sf):
    evidence = adapter.evidence(spark, sf)
    eligible = evidence.groupBy(*CORE).agg(F.count(F.lit(1)).alias("n_entries"))
    row = epi.episode_metrics(_reference(spark, sf), _predicted(spark, sf), eligible, seq.detection_decisions(evidence, 0.55, 0.5))
    return row.withColumns({c: F.round(c, 6) for c in ("mean_latency", "precision", "recall", "f1", "trajectory_false_alarm_rate", "false_positive_rate", "delivery_accuracy", "recovery_accuracy")})


@plans.add("m17_delay_days", _recursive(MATCHES + """SELECT date_trunc('week', a.d) = date_trunc('week', b.d) AS same_week, count(*) AS hits, median(date_diff('day', a.d, b.d)) AS median_delay_days FROM matched m
  JOIN entry a ON a.persona_id = m.persona_id AND a.t_index = m.reference_confirmation JOIN entry b ON b.persona_id = m.persona_id AND b.t_index = m.predicted_confirmation GROUP BY 1"""))
def delays(spark, sf):
    """Days from a reference's confirmation to that of its match, by whether both fall in one week."""
    pairs = epi.match_episodes(_reference(spark, sf), _predicted(spark, sf))
    days = adapter.entry(spark, sf).select("persona_id", "t_index", "d")
    both = pairs.join(days.withColumnsRenamed({"t_index": "reference_confirmation", "d": "rd"}), ["persona_id", "reference_confirmation"]).join(
        days.withColumnsRenamed({"t_index": "predicted_confirmation", "d": "pd"}), ["persona_id", "predicted_confirmation"])
    same = F.date_trunc("week", "rd") == F.date_trunc("week", "pd")
    return both.groupBy(same.alias("same_week")).agg(F.count(F.lit(1)).alias("hits"), F.median(F.datediff("pd", "rd")).alias("median_delay_days"))


@plans.add("x01_label_distribution", "SELECT dimension, score, count(*) AS n FROM label GROUP BY ALL", views=True)
def _(spark, sf):
    return adapter.label(spark, sf).groupBy("dimension", "score").agg(F.count(F.lit(1)).alias("n"))


@plans.add("x02_active_entries", "SELECT persona_id, t_index, CAST(sum(CASE WHEN score <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_active FROM label GROUP BY ALL HAVING sum(CASE WHEN score <> 0 THEN 1 ELSE 0 END) >= 3", views=True)
def _(spark, sf):
    return adapter.label(spark, sf).groupBy("persona_id", "t_index").agg(F.count_if(F.coalesce(F.col("score") != 0, F.lit(False))).alias("n_active")).where("n_active >= 3")


@plans.add("x03_persona_means", "SELECT persona_id, dimension, round(avg(score), 6) AS mean_score FROM label GROUP BY ALL", views=True)
def _(spark, sf):
    return adapter.label(spark, sf).groupBy(*CORE).agg(F.round(F.avg("score"), 6).alias("mean_score"))


PATTERNS = DIPS + """,
f AS (SELECT persona_id, dimension, t_index, score, is_core, lag(score) OVER w AS a, lead(score, 1) OVER w AS n1, lead(score, 2) OVER w AS n2, lag(t_index) OVER w AS ta FROM label WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
g AS (SELECT persona_id, dimension, bool_or(is_core) AS is_core, bool_or(coalesce(a = -1 AND score = -1 AND ta = t_index - 1, false)) AS run2, bool_or(coalesce(a >= 0 AND score = -1, false)) AS dip, bool_or(coalesce(score = 1 AND n1 = 0 AND n2 = 0, false)) AS fade FROM f GROUP BY persona_id, dimension)
"""


def _patterns(spark, sf):
    w, s, no = seq.along(CORE), F.col("score"), F.lit(False)
    rows = adapter.label(spark, sf).select(
        *CORE, "is_core", F.coalesce((F.lag(s).over(w) == -1) & (s == -1) & (F.lag("t_index").over(w) == F.col("t_index") - 1), no).alias("run2"),
        F.coalesce((F.lag(s).over(w) >= 0) & (s == -1), no).alias("dip"), F.coalesce((s == 1) & (F.lead(s, 1).over(w) == 0) & (F.lead(s, 2).over(w) == 0), no).alias("fade"))
    return rows.groupBy(*CORE).agg(*(F.bool_or(c).alias(c) for c in ("is_core", "run2", "dip", "fade")))


@plans.add("x04_pattern_grid", PATTERNS + """SELECT dimension, pattern, count(*) AS n_all, count(*) FILTER (WHERE hit) AS hits_all, count(*) FILTER (WHERE is_core) AS n_core, count(*) FILTER (WHERE is_core AND hit) AS hits_core
  FROM (SELECT dimension, is_core, 'run2' AS pattern, run2 AS hit FROM g UNION ALL SELECT dimension, is_core, 'dip', dip FROM g UNION ALL SELECT dimension, is_core, 'fade', fade FROM g) GROUP BY ALL""", views=True)
def _(spark, sf):
    long = _patterns(spark, sf).unpivot(["dimension", "is_core"], ["run2", "dip", "fade"], "pattern", "hit")
    return long.groupBy("dimension", "pattern").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("hit").alias("hits_all"), F.count_if("is_core").alias("n_core"), F.count_if(F.col("is_core") & F.col("hit")).alias("hits_core"))


@plans.add("x05_persona_coverage", PATTERNS + "SELECT count(*) AS n_personas, count(*) FILTER (WHERE hit) AS n_flagged FROM (SELECT persona_id, bool_or(is_core AND run2) AS hit FROM g GROUP BY persona_id)", views=True)
def _(spark, sf):
    return _patterns(spark, sf).groupBy("persona_id").agg(F.bool_or(F.col("is_core") & F.col("run2")).alias("hit")).agg(F.count(F.lit(1)).alias("n_personas"), F.count_if("hit").alias("n_flagged"))


@plans.add("x06_heavy_weeks", """SELECT persona_id, dimension, is_core, CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN score = -1 THEN 1.0 ELSE 0.0 END), 6) AS density
  FROM label GROUP BY ALL HAVING count(*) FILTER (WHERE score = -1) >= 2""", views=True)
def _(spark, sf):
    bad = F.coalesce(F.col("score") == -1, F.lit(False))
    return adapter.label(spark, sf).groupBy(*CORE, "is_core", F.date_trunc("week", "d").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(bad.cast("double")), 6).alias("density"), F.count_if(bad).alias("_bad")).where("_bad >= 2").drop("_bad")


@plans.add("x07_run_histogram", """
WITH p AS (SELECT persona_id, dimension, t_index, coalesce(score = -1, false) AS hit, row_number() OVER w AS i FROM label WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
r AS (SELECT persona_id, dimension, i - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM p WHERE hit),
n AS (SELECT persona_id, dimension, count(*) AS n FROM r GROUP BY persona_id, dimension, g),
l AS (SELECT k.persona_id, k.dimension, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT persona_id, dimension FROM label) k LEFT JOIN n USING (persona_id, dimension) GROUP BY k.persona_id, k.dimension)
SELECT CAST(longest AS BIGINT) AS longest, count(*) AS n FROM l GROUP BY ALL""", views=True)
def _(spark, sf):
    return seq.longest_run(adapter.label(spark, sf), conflict()).groupBy("longest").agg(F.count(F.lit(1)).alias("n"))


@plans.add("x08_self_recovery", DIPS + """SELECT is_core, count(recovered) AS n_dips, round(avg(CASE WHEN recovered THEN 1.0 WHEN NOT recovered THEN 0.0 END), 6) AS share FROM dip GROUP BY is_core""", views=True)
def _(spark, sf):
    df = adapter.label(spark, sf)
    return seq.dips(df, keys=(*CORE, "is_core")).groupBy("is_core").agg(F.count("recovered").alias("n_dips"), F.round(F.avg(F.col("recovered").cast("double")), 6).alias("share"))


@plans.add("x30_merge_overlaps", _recursive("""WITH RECURSIVE sp AS (SELECT persona_id AS case_id, event_id AS alert, t_index AS onset, t_index + k % 3 AS fin FROM entry),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY alert, onset, fin) AS i FROM sp),
g AS (SELECT case_id, i, [{'alert': alert, 'onset': onset, 'fin': fin}] AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT case_id, i, CASE WHEN coalesce(h, 0) = 0 THEN list_append(kept, {'alert': alert, 'onset': onset, 'fin': fin}) ELSE list_transform(kept, lambda x, j: CASE WHEN j = h THEN {'alert': x.alert, 'onset': x.onset, 'fin': greatest(x.fin, fin)} ELSE x END) END
  FROM (SELECT o.case_id, o.i, o.alert, o.onset, o.fin, g.kept, list_position(list_transform(g.kept, lambda x: o.onset <= x.fin AND o.fin >= x.onset), true) AS h FROM g JOIN o ON o.case_id = g.case_id AND o.i = g.i + 1)),
z AS (SELECT case_id, unnest(arg_max(kept, i)) AS x FROM g GROUP BY 1)
SELECT case_id, x.alert AS alert, x.onset AS onset, x.fin AS "end" FROM z"""))
def merged(spark, sf):
    spans = adapter.entry(spark, sf).select(F.col("persona_id").alias("case_id"), F.col("event_id").alias("alert"), F.col("t_index").alias("onset"), (F.col("t_index") + F.col("k") % 3).alias("end"))
    return epi.merge_overlaps(spans)


@plans.add("x52_collapse_yes_pairs", """
WITH s AS (SELECT persona_id, dimension, t_index, verdict AS a, lead(verdict) OVER w AS b, lead(t_index) OVER w AS n FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
y AS (SELECT persona_id, dimension, t_index, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM s WHERE n = t_index + 1 AND a = 'conflict' AND b = 'conflict')
SELECT persona_id, dimension, min(t_index) AS first_t_index, max(t_index) + 1 AS last_t_index, count(*) AS n_pairs FROM y GROUP BY persona_id, dimension, g""", views=True)
def _(spark, sf):
    pairs = seq.adjacent_pairs(adapter.decision(spark, sf), columns=("verdict",)).where("verdict = 'conflict' and next_verdict = 'conflict'")
    runs = pairs.withColumn("run", F.col("t_index") - F.row_number().over(seq.along(CORE)))
    return runs.groupBy(*CORE, "run").agg(F.min("t_index").alias("first_t_index"), (F.max("t_index") + 1).alias("last_t_index"), F.count(F.lit(1)).alias("n_pairs")).drop("run")
