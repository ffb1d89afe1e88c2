"""Cases, evidence, acceptance, inventory, circumplex, gates and placement over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.adapter import table
from pathwise.functions import scalars as fn
from pathwise.functions import tables
from pathwise.operators import cases as ca
from pathwise.operators import episodes as epi
from pathwise.operators import metrics as met
from pathwise.operators import relational as rel
from pathwise.operators import resample as res
from pathwise.operators import reviewed as rev
from pathwise.operators import sequence as seq
from pathwise.plans import composites
from pathwise.plans import labels as lab
from pathwise.plans import reviewed as rvw
from pathwise.plans.base import Plans
from pathwise.plans.sequence import CORE, MACHINE, REFERENCE, _recursive
from pathwise.plans.weekly import _drawn, _u
from pathwise.schema import DIMS
from pathwise.session import checkpointed
from pathwise.streaming import live

plans = Plans()
CELL = ["event_id", "dimension"]
PAIR_ROWS = ", ".join(f"('{relation}', '{a}', '{b}')" for relation, some in (("adjacent", met.ADJACENT), ("opposite", met.OPPOSITE)) for a, b in some)


def _week(column: str):
    return F.date_trunc("week", column).cast("date")


@plans.add("m13_circumplex", f"""WITH pr(relation, l, r) AS (VALUES {PAIR_ROWS}), whole AS (SELECT event_id FROM label GROUP BY 1 HAVING count(score) = 10),
pv AS (SELECT event_id, dimension, avg(CASE WHEN score = 1 THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN score = -1 THEN 1.0 ELSE 0 END) AS m FROM vote GROUP BY 1, 2),
s AS (SELECT 'scores' AS source, relation, l, r, avg(CASE relation WHEN 'adjacent' THEN greatest(a.score, 0) * greatest(b.score, 0) ELSE greatest(a.score * b.score, 0) END) AS score FROM pr JOIN label a ON a.dimension = l JOIN label b ON b.dimension = r AND b.event_id = a.event_id JOIN whole w ON w.event_id = a.event_id GROUP BY ALL
  UNION ALL SELECT 'probabilities', relation, l, r, avg(a.p * b.p + CASE relation WHEN 'opposite' THEN a.m * b.m ELSE 0 END) FROM pr JOIN pv a ON a.dimension = l JOIN pv b ON b.dimension = r AND b.event_id = a.event_id GROUP BY ALL)
SELECT source, relation, l AS left_dim, r AS right_dim, round(score, 9) AS score, round(avg(score) OVER (PARTITION BY source, relation), 9) AS mean FROM s""", views=True)
def _(spark, sf):
    """12 adjacent and 12 opposite pairs by expected scores and by probabilities."""
    shares = adapter.vote(spark, sf).groupBy(*CELL).agg(F.avg((F.col("score") == 1).cast("double")).alias("p"), F.avg((F.col("score") == -1).cast("double")).alias("m"))
    both = met.circumplex(adapter.label(spark, sf), "event_id", score="score").withColumn("source", F.lit("scores")).unionByName(met.circumplex(shares, "event_id", plus="p", minus="m").withColumn("source", F.lit("probabilities")))
    return both.select("source", "relation", F.col("left").alias("left_dim"), F.col("right").alias("right_dim"), F.round("score", 9).alias("score"), F.round("mean", 9).alias("mean"))


# Prompts' windows: made of the entries, with faults by whole-number rules.

WINDOWS = """ent AS (SELECT persona_id, t_index, d, event_id, CAST(date_trunc('week', d) AS DATE) AS week, 'h' || event_id AS text_hash FROM entry),
wks AS (SELECT DISTINCT persona_id, week FROM ent UNION ALL SELECT DISTINCT persona_id, week FROM ent WHERE persona_id % 13 = 6),
win AS (SELECT w.persona_id, w.week, row_number() OVER () AS w FROM wks w),
vis AS (SELECT win.w, win.persona_id, win.week, e.t_index, e.event_id, CASE WHEN e.event_id % 71 = 3 THEN 'x' ELSE e.text_hash END AS shown, e.text_hash FROM win JOIN ent e ON e.persona_id = win.persona_id AND e.week <= win.week WHERE e.week = win.week OR e.event_id % 61 <> 5),
now AS (SELECT win.w, win.persona_id, win.week, e.t_index, e.event_id FROM win JOIN ent e ON e.persona_id = win.persona_id AND e.week = win.week WHERE e.event_id % 67 <> 9)"""


def _windows(spark, sf):
    e = adapter.entry(spark, sf).withColumns({"week": _week("d"), "text_hash": F.concat(F.lit("h"), F.col("event_id").cast("string"))})
    spot = F.struct("t_index", "event_id", "week", F.when(F.col("event_id") % 71 == 3, "x").otherwise(F.col("text_hash")).alias("shown"))
    weeks = e.groupBy("persona_id", "week").agg(F.sort_array(F.collect_list(spot)).alias("_own"))
    upto = F.flatten(F.collect_list("_own").over(Window.partitionBy("persona_id").orderBy("week")))
    weeks = weeks.withColumn("_all", F.filter(upto, lambda x: (x["week"] == F.col("week")) | (x["event_id"] % 61 != 5)))
    last = F.element_at("_own", -1)["t_index"]
    weeks = weeks.select(
        "persona_id", F.col("week").alias("week_start"), F.date_add("week", 6).alias("week_end"), F.transform("_all", lambda x: x["t_index"]).alias("visible"), F.transform(F.filter("_own", lambda x: x["event_id"] % 67 != 9), lambda x: x["t_index"]).alias("current"),
        F.map_from_entries(F.transform("_all", lambda x: F.struct(x["t_index"], x["shown"]))).alias("shown"), F.when((F.col("persona_id") % 11 == 4) & (F.dayofmonth("week") % 2 == 0), last - 1).otherwise(last).alias("cutoff"))
    return weeks.unionByName(weeks.where("persona_id % 13 = 6")), e


@plans.add("x22_window_completeness", f"""WITH {WINDOWS}, fact AS (SELECT w, win.persona_id, win.week, (SELECT count(*) FROM ent e WHERE e.persona_id = win.persona_id AND e.week <= win.week) AS n_visible, (SELECT count(*) FROM vis WHERE vis.w = win.w) AS visible,
  (SELECT count(*) FROM ent e WHERE e.persona_id = win.persona_id AND e.week = win.week) AS n_now, (SELECT count(*) FROM now WHERE now.w = win.w) AS now, (SELECT bool_and(shown = text_hash) FROM vis WHERE vis.w = win.w) AS texts FROM win),
bad AS (SELECT persona_id, week, 'history boundary' AS problem FROM fact WHERE visible <> n_visible UNION ALL SELECT persona_id, week, 'current-week boundary' FROM fact WHERE now <> n_now
  UNION ALL SELECT persona_id, week, 'history text' FROM fact WHERE NOT texts UNION ALL SELECT persona_id, week, 'cutoff' FROM fact WHERE persona_id % 11 = 4 AND day(week) % 2 = 0 UNION ALL SELECT persona_id, week, 'duplicate prompt' FROM fact WHERE persona_id % 13 = 6),
lost AS (SELECT e.persona_id, e.t_index, (SELECT count(*) FROM now WHERE now.persona_id = e.persona_id AND now.t_index = e.t_index) AS n FROM ent e)
SELECT persona_id, CAST(week AS VARCHAR) AS place, problem, count(*) AS n FROM bad GROUP BY ALL UNION ALL SELECT persona_id, CAST(t_index AS VARCHAR), 'coordinate', n FROM lost WHERE n <> 1""", views=True)
def _(spark, sf):
    """Problems of prompts' windows, and coordinates that are not in exactly one of them."""
    found, lost = ca.window_problems(*_windows(spark, sf))
    found = found.groupBy("persona_id", F.col("week_start").cast("string").alias("place"), "problem").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(lost.select("persona_id", F.col("t_index").cast("string").alias("place"), F.lit("coordinate").alias("problem"), F.col("n_windows").alias("n")))


RUN_ROWS = """rr AS (SELECT persona_id, dimension, t_index, run, review_status = 'ok' AND (event_id + run) % 9 <> 0 AS ok, verdict FROM decision CROSS JOIN (VALUES (1), (2), (3)) v(run)),
tk AS (SELECT *, CASE WHEN ok THEN verdict ELSE 'invalid' END AS token, CASE WHEN ok THEN verdict ELSE 'abstain' END AS v FROM rr),
rs AS (SELECT persona_id, dimension, run, min(t_index) AS onset, max(t_index) AS last FROM (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension, run ORDER BY t_index) AS g FROM rr WHERE ok AND verdict = 'conflict') GROUP BY persona_id, dimension, run, g HAVING count(*) >= 2),
st AS (SELECT k.persona_id, k.dimension, k.run, coalesce(string_agg(onset || '-' || last, ',' ORDER BY onset), '') AS spans FROM (SELECT DISTINCT persona_id, dimension, run FROM rr) k LEFT JOIN rs ON rs.persona_id = k.persona_id AND rs.dimension = k.dimension AND rs.run = k.run GROUP BY ALL),
bt AS (SELECT persona_id, dimension, bool_or(n > 1) AS by_token FROM (SELECT persona_id, dimension, t_index, count(DISTINCT token) AS n FROM tk GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT persona_id, dimension, count(DISTINCT spans) > 1 AS by_spans FROM st GROUP BY ALL),
dis AS (SELECT bt.persona_id, bt.dimension, by_token, by_spans FROM bt JOIN bs ON bs.persona_id = bt.persona_id AND bs.dimension = bt.dimension WHERE by_token OR by_spans)"""


def _runs(spark, sf):
    run = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    d = adapter.decision(spark, sf).withColumn("_run", run)
    return ca.run_tokens(d, F.col("_run"), (F.col("event_id") + F.col("_run")) % 9 == 0)


@plans.add("x18_run_disagreement", f"WITH {RUN_ROWS} SELECT * FROM dis", views=True)
def _(spark, sf):
    rows = _runs(spark, sf)
    return ca.run_disagreement(rows, ca.run_spans(rows))


def _sub(sql: str) -> str:
    return "(" + sql.strip().rstrip(";") + ")"


@plans.add("x17_review_queues", f"""WITH k AS (SELECT DISTINCT persona_id, dimension FROM decision), {RUN_ROWS}, ref AS (SELECT * FROM {_sub(adapter.over_views(REFERENCE + " SELECT DISTINCT persona_id, dimension FROM ref"))}),
models AS (SELECT * FROM {_sub(composites.plans.oracles["x19_model_disagreement"])}), mt AS (SELECT * FROM {_sub(rvw.plans.oracles["x20_case_metrics"])}),
pr AS (SELECT persona_id, dimension, t_index, v AS a, lead(v) OVER w AS b, lead(t_index) OVER w AS n FROM tk WINDOW w AS (PARTITION BY persona_id, dimension, run ORDER BY t_index)),
q AS (SELECT persona_id, dimension, 'All persona/Core Value cases' AS queue FROM k UNION SELECT persona_id, dimension, 'Reference Drift' FROM ref UNION SELECT persona_id, dimension, 'Uncertain LLM-Judge Conflict Label' FROM label WHERE score IS NULL
  UNION SELECT persona_id, dimension, 'Model disagreement' FROM models UNION SELECT persona_id, dimension, 'Run disagreement' FROM dis UNION SELECT persona_id, dimension, 'Invalid response' FROM rr WHERE NOT ok
  UNION SELECT persona_id, dimension, 'Unresolved because of Abstain' FROM pr WHERE n = t_index + 1 AND (a = 'abstain' OR b = 'abstain') AND a <> 'not_conflict' AND b <> 'not_conflict'
  UNION SELECT persona_id, dimension, 'Missed Drift' FROM mt WHERE missed > 0 UNION SELECT persona_id, dimension, 'False Drift alert' FROM mt WHERE false_alerts > 0)
SELECT q.* FROM q JOIN k ON k.persona_id = q.persona_id AND k.dimension = q.dimension""", views=True)
def _(spark, sf):
    """All nine queues, over three runs of one setup. Cases are of core dimensions, so labels and votes of others can't be in one.
    What is left of a run (its spans) and the reference's episodes are kept, as several queues read them."""
    rows, core = _runs(spark, sf), adapter.label(spark, sf).where("is_core")
    cases = checkpointed(ca.run_profiles(rows))
    reference = checkpointed(seq.reference_episodes(core).select(*ca.CASE, "episode_id", "onset_t_index", "confirmation_t_index", "end_t_index", "delivery_state"))
    spans = cases.select("repeat", *ca.CASE, F.inline("spans"))
    predicted = spans.select(
        "repeat", *ca.CASE, F.col("onset").cast("string").alias("episode_id"), F.col("onset").alias("onset_t_index"), (F.col("onset") + 1).alias("confirmation_t_index"), F.lit("drift").alias("delivery_state"))
    models = composites._models_differ(adapter.vote(spark, sf).where(adapter._core()))
    return ca.review_queues(cases, reference, core, models, ca.run_disagreement(rows, spans), rev.case_errors(cases, reference, predicted))


@plans.add("q11_evidence_pick", """WITH s AS (SELECT persona_id, CAST(date_trunc('week', d) AS DATE) AS week, t_index, avg(score) AS m, avg(score) FILTER (WHERE dim_index < 4) AS tension, avg(score) FILTER (WHERE dim_index >= 6) AS strength FROM label GROUP BY persona_id, d, t_index),
a AS (SELECT *, count(*) OVER (PARTITION BY persona_id, week) AS n, row_number() OVER (PARTITION BY persona_id, week ORDER BY tension NULLS LAST, m NULLS LAST, t_index) AS i FROM s),
b AS (SELECT * FROM a WHERE i > CASE WHEN n <= 2 THEN 1 ELSE 2 END QUALIFY row_number() OVER (PARTITION BY persona_id, week ORDER BY strength DESC NULLS LAST, m DESC NULLS LAST, t_index) = 1)
SELECT persona_id, week, t_index, 'misaligned' AS direction, i AS rank, coalesce(tension < 0, false) AS "primary" FROM a WHERE i <= CASE WHEN n <= 2 THEN 1 ELSE 2 END UNION ALL SELECT persona_id, week, t_index, 'aligned', 1, coalesce(strength > 0, false) FROM b""", views=True)
def _(spark, sf):
    """What each week's digest cites: misaligned entries by tension, then the best aligned one of the rest."""
    over = lambda c: F.avg(F.when(c, F.col("score")))
    rows = adapter.label(spark, sf).groupBy("persona_id", _week("d").alias("week"), "t_index").agg(F.avg("score").alias("m"), over(F.col("dim_index") < 4).alias("tension"), over(F.col("dim_index") >= 6).alias("strength"))
    return ca.evidence_picks(rows)


@plans.add("v10_pair_acceptance", """WITH e AS (SELECT a.persona_id || '-' || a.t_index // 2 || '-' || a.dimension AS pair_id, a.event_id, a.score AS la, b.score AS lb FROM vote a JOIN vote b ON b.event_id = a.event_id AND b.dimension = a.dimension AND b.pass = 2 WHERE a.pass = 1),
p AS (SELECT pair_id, bool_and(la = lb) AS label_agreement, count(*) FILTER (WHERE la = lb AND la = 1) > 0 AND count(*) FILTER (WHERE la = lb AND la = -1) > 0 AND count(*) FILTER (WHERE la = lb AND la = 0) = 0 AS opposite, count(DISTINCT event_id) AS n_entries, min(event_id) AS e FROM e GROUP BY 1)
SELECT pair_id, label_agreement, opposite, label_agreement AND opposite AND e % 7 <> 0 AND e % 8 <> 1 AND e % 9 <> 2 AND e % 10 <> 3 AND e % 11 <> 4 AND e % 12 <> 5 AND e % 13 <> 6 AND e % 14 <> 7 AS accepted, n_entries FROM p""", views=True)
def _(spark, sf):
    """Pairs of entries that both reviewers label alike, opposite, comparable, realistic, acceptable and without issue."""
    v = adapter.vote(spark, sf)
    pair = F.concat_ws("-", F.col("persona_id").cast("string"), F.floor(F.col("t_index") / 2).cast("string"), "dimension")
    label = lambda p: F.max(F.when(F.col("pass") == p, F.col("score")))
    entries = v.groupBy(pair.alias("pair_id"), F.col("event_id").alias("entry_id")).agg(label(1).alias("label_a"), label(2).alias("label_b"))
    e = F.col("e")
    said = lambda n, k: F.when(e % n == k, "no").otherwise("yes")
    review = lambda name, ns: F.struct(F.lit(name).alias("reviewer"), *(said(n, k).alias(c) for c, (n, k) in zip(("comparable", "realistic", "accept"), ns, strict=False)), F.when(e % ns[3][0] == ns[3][1], F.array(F.lit("issue"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    reviews = entries.groupBy("pair_id").agg(F.min("entry_id").alias("e")).select("pair_id", F.inline(F.array(review("a", [(7, 0), (8, 1), (9, 2), (10, 3)]), review("b", [(11, 4), (12, 5), (13, 6), (14, 7)]))))
    return ca.accepted_pairs(entries, reviews)


@plans.add("x24_state_evidence", _recursive(MACHINE + """, last AS (SELECT persona_id, dimension, arg_max(state, t_index) AS state, arg_max(run, t_index) AS run FROM m GROUP BY ALL),
r AS (SELECT d.persona_id, d.dimension, d.t_index, d.d BETWEEN DATE '2024-01-16' AND DATE '2024-01-18' AS inside, state, run, row_number() OVER (PARTITION BY d.persona_id, d.dimension ORDER BY d.t_index DESC) AS i FROM decision d JOIN last l ON l.persona_id = d.persona_id AND l.dimension = d.dimension),
w AS (SELECT *, bool_or(inside) OVER (PARTITION BY persona_id, dimension) AS any_inside, row_number() OVER (PARTITION BY persona_id, dimension, inside ORDER BY t_index DESC) AS j FROM r)
SELECT persona_id, dimension, t_index, CASE WHEN any_inside THEN 'window' WHEN state = 'active_drift' THEN 'open drift' ELSE 'latest' END AS why FROM w
WHERE CASE WHEN any_inside THEN inside AND j <= 3 WHEN state = 'active_drift' THEN i <= least(3, run) ELSE i <= 3 END"""))
def _(spark, sf):
    """The decisions that explain each trajectory's state: of a window, of an open drift, or the latest."""
    d = adapter.decision(spark, sf)
    day = lambda x: F.lit(x).cast("date")
    return ca.state_evidence(d, epi.current_states(d), day("2024-01-16"), day("2024-01-18"))


HARD = ("hedonism", "security", "stimulation")


@plans.add("x14_gate", "WITH " + _drawn("SELECT persona_id, dimension, count(*) FILTER (WHERE score <> 0 AND confidence IN ('no_majority', 'bare_majority')) AS hits, count(*) FILTER (WHERE score <> 0) AS n FROM label WHERE dimension IN ('hedonism', 'security', 'stimulation') GROUP BY 1, 2", "persona_id", "hits", "n", 200, "dimension").replace("SELECT dimension, round(", ", iv AS (SELECT dimension, round(", 1) + """),
pt AS (SELECT dimension, count(*) FILTER (WHERE score <> 0) AS n_non_neutral, round(count(*) FILTER (WHERE score <> 0 AND confidence IN ('no_majority', 'bare_majority')) / count(*) FILTER (WHERE score <> 0), 9) AS ratio FROM label WHERE dimension IN ('hedonism', 'security', 'stimulation') GROUP BY 1)
SELECT pt.dimension, n_non_neutral, ratio, low, high, isfinite(high) AND high < 0.5 AS passes, bool_and(isfinite(high) AND high < 0.5) OVER () AS overall_passed FROM pt JOIN iv ON iv.dimension = pt.dimension""", views=True)
def _(spark, sf):
    """Whether the bootstrap interval of every hard dimension's share of unsure non-neutral labels ends below a half."""
    rows = adapter.label(spark, sf).where(F.col("dimension").isin(*HARD))
    strong = F.col("score") != 0
    c = rows.groupBy("persona_id", "dimension").agg(F.count_if(strong & F.col("confidence").isin("no_majority", "bare_majority")).alias("hits"), F.count_if(strong).alias("n"))
    bounds = res.percentile_interval(res.cluster_bootstrap(c, "persona_id", "hits", "n", 200, by=("dimension",)), ("dimension",))
    points = c.groupBy("dimension").agg(F.sum("n").alias("n_non_neutral"), F.round(F.sum("hits") / F.sum("n"), 9).alias("ratio"))
    high = F.round("high", 9)
    passes = F.coalesce(~F.isnan(high) & (high < 0.5), F.lit(False))
    out = points.join(bounds, "dimension").select("dimension", "n_non_neutral", "ratio", F.round("low", 9).alias("low"), high.alias("high"), passes.alias("passes"))
    return out.withColumn("overall_passed", F.bool_and("passes").over(Window.partitionBy()))  # three rows


@plans.add("b06_placement_test", REFERENCE + f""", opp AS (SELECT persona_id, CAST(date_trunc('week', d) AS DATE) AS week, t_index AS cutoff, p_minus1 FROM evidence WHERE t_index % 3 = 0),
trg AS (SELECT persona_id, week, min(cutoff) AS cutoff FROM opp WHERE p_minus1 > 0.9 GROUP BY 1, 2), rf AS (SELECT r.persona_id, CAST(date_trunc('week', e.d) AS DATE) AS week, min(confirmation_t_index) AS first FROM ref r JOIN entry e ON e.persona_id = r.persona_id AND e.t_index = r.confirmation_t_index GROUP BY 1, 2),
seen AS (SELECT count(*) AS n, count(*) FILTER (WHERE first <= cutoff) AS hits FROM trg LEFT JOIN rf USING (persona_id, week)),
oh AS (SELECT persona_id, week, list(coalesce(first <= cutoff, false) ORDER BY cutoff, coalesce(first <= cutoff, false)) AS hits, persona_id || ':' || week AS name FROM opp LEFT JOIN rf USING (persona_id, week) GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY {_u("7", "replicate", "name")}, name) AS k FROM oh CROSS JOIN (SELECT unnest(range(0, 60)) AS replicate)),
rt AS (SELECT replicate, count(*) FILTER (WHERE hits[1 + CAST(least(floor({_u("8", "replicate", "name")} * len(hits)), len(hits) - 1) AS BIGINT)]) / (SELECT n FROM seen) AS rate FROM dr WHERE k <= (SELECT n FROM seen) GROUP BY 1)
SELECT (SELECT count(*) FROM oh) AS n_weeks, n AS n_triggers, hits / n AS observed_rate, round(avg(rate), 9) AS random_mean, round(median(rate), 9) AS random_median, round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high,
  count(*) FILTER (WHERE rate <= hits / n) / count(*) AS percentile, (1 + count(*) FILTER (WHERE rate >= hits / n)) / (count(*) + 1) AS p, count(*) AS n_replicates FROM rt, seen GROUP BY n, hits""", views=True)
def _(spark, sf):
    """Whether sure evidence falls into weeks with a confirmed episode more often than random placements do."""
    opportunities = adapter.evidence(spark, sf).where("t_index % 3 = 0").select("persona_id", _week("d").alias("week"), F.col("t_index").alias("cutoff"), "p_minus1")
    triggers = opportunities.where("p_minus1 > 0.9").groupBy("persona_id", "week").agg(F.min("cutoff").alias("cutoff"))
    days = adapter.entry(spark, sf).select("persona_id", F.col("t_index").alias("confirmation"), "d")
    references = rvw._reference(spark, sf).select("persona_id", F.col("confirmation_t_index").alias("confirmation")).join(days, ["persona_id", "confirmation"]).select("persona_id", _week("d").alias("week"), "confirmation")
    out = res.placement_test(opportunities.select("persona_id", "week", "cutoff"), triggers, references, ["persona_id", "week"], 60)
    return out.withColumns({c: F.round(c, 9) for c in ("random_mean", "random_median", "low", "high")})


@plans.add("v11_response_consistency", """WITH x AS (SELECT persona_id || ':' || dimension AS case_id, persona_id, t_index, event_id, CASE verdict WHEN 'conflict' THEN 'yes' WHEN 'not_conflict' THEN 'no' ELSE 'uncertain' END AS decision, event_id % 97 = 8 AS other FROM decision),
k AS (SELECT case_id, persona_id, bool_or(event_id % 83 = 5 OR event_id % 89 = 7) AS cover, bool_or(decision = 'yes' AND other AND event_id % 83 <> 5) AS reason, bool_or(decision = 'uncertain' AND event_id % 83 <> 5) AS open_ FROM x GROUP BY 1, 2),
p AS (SELECT DISTINCT a.case_id FROM x a JOIN x b ON b.case_id = a.case_id AND b.t_index = a.t_index + 1 WHERE a.decision = 'yes' AND b.decision = 'yes' AND a.event_id % 83 <> 5 AND b.event_id % 83 <> 5),
f AS (SELECT k.*, p.case_id IS NOT NULL AS pair, CASE WHEN persona_id % 3 = 0 THEN 'yes' WHEN persona_id % 3 = 1 THEN 'no' ELSE 'uncertain' END AS sustained, persona_id % 19 <> 6 AS said FROM k LEFT JOIN p ON p.case_id = k.case_id)
SELECT case_id, 'entry coverage' AS problem FROM f WHERE cover UNION ALL SELECT case_id, 'reason of a yes' FROM f WHERE reason UNION ALL SELECT case_id, 'missing case' FROM f WHERE NOT said UNION ALL SELECT case_id, 'rationale' FROM f WHERE said AND persona_id % 17 = 5
UNION ALL SELECT case_id, 'sustained' FROM f WHERE said AND NOT CASE WHEN pair THEN sustained = 'yes' ELSE sustained = 'no' OR (sustained = 'uncertain' AND open_) END""", views=True)
def _(spark, sf):
    """Problems of a reviewer's response: coverage, reasons, sustained conflict, rationale."""
    v, e, p = F.col("verdict"), F.col("event_id"), F.col("persona_id")
    decision = F.when(v == "conflict", "yes").when(v == "not_conflict", "no").otherwise("uncertain")
    case = F.concat_ws(":", p.cast("string"), "dimension").alias("case_id")
    rows = adapter.decision(spark, sf).select(case, "persona_id", "event_id", F.col("t_index").alias("position"), decision.alias("decision"), F.when(e % 97 == 8, "other").otherwise(ca.YES_REASON).alias("reason"))
    given = rows.where("event_id % 83 <> 5")
    verdicts = rows.select("case_id", "persona_id").distinct().where(p % 19 != 6).select("case_id", F.when(p % 3 == 0, "yes").when(p % 3 == 1, "no").otherwise("uncertain").alias("sustained"), F.when(p % 17 == 5, " ").otherwise("because").alias("rationale"))
    return ca.response_problems(rows, given.unionByName(given.where("event_id % 89 = 7")), verdicts)


SOURCES = """hit AS (SELECT l.persona_id, l.dimension, l.t_index, coalesce(l.score = -1, false) AS a, coalesce(d.verdict = 'conflict', false) AS b FROM label l LEFT JOIN decision d ON d.event_id = l.event_id AND d.dimension = l.dimension WHERE l.is_core),
bef AS (SELECT *, coalesce(lag(a) OVER w, false) AS pa, coalesce(lag(b) OVER w, false) AS pb FROM hit WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
inv AS (SELECT persona_id, dimension, count(*) AS length, count(*) FILTER (WHERE a AND NOT pa) AS label_runs, count(*) FILTER (WHERE a AND pa) AS label_windows, bool_or(a AND pa) AS label_candidate, count(*) FILTER (WHERE b AND NOT pb) AS review_runs, count(*) FILTER (WHERE b AND pb) AS review_windows, bool_or(b AND pb) AS review_candidate,
  sha256(string_agg(t_index || ':' || CAST(a AS INTEGER) || ':' || CAST(b AS INTEGER), '|' ORDER BY t_index)) AS content_sha256, concat_ws(',', CASE WHEN bool_or(a AND pa) THEN 'label' END, CASE WHEN bool_or(b AND pb) THEN 'review' END) AS sources FROM bef GROUP BY 1, 2)"""


def _inventory(spark, sf):
    d = adapter.decision(spark, sf).select(*CELL, "verdict")
    rows = adapter.label(spark, sf).where("is_core").join(d, CELL, "left")
    return ca.inventory(rows, {"label": F.col("score") == -1, "review": F.col("verdict") == "conflict"})


@plans.add("x11_inventory", f"WITH {SOURCES} SELECT * FROM inv", views=True)
def _(spark, sf):
    """Every case with both label sources side by side: runs, windows, candidates and a hash of its content."""
    return _inventory(spark, sf)


@plans.add("a15_expected_counts", f"""WITH {SOURCES}, c AS (SELECT * FROM inv WHERE label_candidate OR review_candidate)
SELECT count(*) AS candidates, count(DISTINCT persona_id) AS candidate_personas, CAST(sum(length) AS BIGINT) AS selected_entries, count(*) FILTER (WHERE label_candidate AND review_candidate) AS source_both, count(*) FILTER (WHERE label_candidate AND NOT review_candidate) AS source_label_only,
  count(*) FILTER (WHERE review_candidate AND NOT label_candidate) AS source_review_only, count(*) FILTER (WHERE persona_id % 4 = 3) AS retired, (SELECT count(*) FROM inv WHERE NOT label_candidate AND NOT review_candidate) AS other_cases, (SELECT count(*) FROM inv) AS cases FROM c""", views=True)
def _(spark, sf):
    """Nine counts of the inventory, asserted against those that its parts give."""
    inv = _inventory(spark, sf)
    a, b = F.col("label_candidate"), F.col("review_candidate")
    own = a | b
    counts = inv.agg(
        F.count_if(own).alias("candidates"), F.count_distinct(F.when(own, F.col("persona_id"))).alias("candidate_personas"), F.sum(F.when(own, F.col("length"))).alias("selected_entries"), F.count_if(a & b).alias("source_both"), F.count_if(a & ~b).alias("source_label_only"),
        F.count_if(b & ~a).alias("source_review_only"), F.count_if(own & (F.col("persona_id") % 4 == 3)).alias("retired"), F.count_if(~own).alias("other_cases"), F.count(F.lit(1)).alias("cases"))
    seen = inv.groupBy("sources").agg(F.count(F.lit(1)).alias("n")).collect()  # four rows at most
    by = {r["sources"]: r["n"] for r in seen}
    parts = counts.select("source_both", "source_label_only", "source_review_only", "other_cases")
    ca.assert_counts(parts, {"source_both": by.get("label,review", 0), "source_label_only": by.get("label", 0), "source_review_only": by.get("review", 0), "other_cases": by.get("", 0)})
    return counts


@plans.add("x10_full_cases", """WITH e AS (SELECT persona_id, t_index, CASE WHEN event_id % 397 = 0 THEN '  ' ELSE ' ' || event_type END AS text FROM entry WHERE event_id % 409 <> 1),
p AS (SELECT persona_id, count(*) AS n, min(t_index) = 0 AND max(t_index) = count(*) - 1 AS whole, min(t_index) FILTER (WHERE trim(text) = '') AS blank FROM e GROUP BY 1),
c AS (SELECT 'train:' || l.persona_id || ':' || l.dimension AS case_id, p.n AS n_entries, NULL::VARCHAR AS problem FROM (SELECT DISTINCT persona_id, dimension FROM label WHERE is_core) l JOIN p ON p.persona_id = l.persona_id WHERE whole AND blank IS NULL)
SELECT c.*, (SELECT md5(string_agg(trim(text), '|' ORDER BY t_index)) FROM e WHERE e.persona_id = CAST(split_part(case_id, ':', 2) AS BIGINT)) AS content FROM c
UNION ALL SELECT 'persona:' || persona_id, n, CASE WHEN NOT whole THEN 'non-contiguous positions' ELSE 'missing text at ' || blank END, NULL FROM p WHERE NOT whole OR blank IS NOT NULL""", views=True)
def _(spark, sf):
    """Whole trajectories of declared values, and why the others are none."""
    e = adapter.entry(spark, sf).where("event_id % 409 <> 1").select("persona_id", "t_index", F.when(F.col("event_id") % 397 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"))
    found = ca.full_cases(e, adapter.label(spark, sf).where("is_core"), "train")
    bad = ca.trajectory_problems(e).where("problem is not null")
    content = F.md5(F.array_join(F.transform("entries", lambda x: x["text"]), "|"))
    good = found.select("case_id", "n_entries", F.lit(None).cast("string").alias("problem"), content.alias("content"))
    return good.unionByName(bad.select(F.concat(F.lit("persona:"), F.col("persona_id").cast("string")).alias("case_id"), "n_entries", "problem", F.lit(None).cast("string").alias("content")))


def _kappa(where: str = "true") -> str:
    n, x, y, xx, yy, xy = (f"({f} FILTER (WHERE {where}))" for f in ("count(*)", "sum(target::DOUBLE)", "sum(predicted::DOUBLE)", "sum(target * target::DOUBLE)", "sum(predicted * predicted::DOUBLE)", "sum(target * predicted::DOUBLE)"))
    return f"CASE WHEN {n} * {xx} - {x} * {x} > 0 AND {n} * {yy} - {y} * {y} > 0 THEN 1 - {n} * ({xx} + {yy} - 2 * {xy}) / ({n} * {xx} + {n} * {yy} - 2 * {x} * {y}) END"


MEASURES = f"""ms AS (SELECT persona_id % 5 AS run, {_kappa()} AS qwk_mean, count(*) FILTER (WHERE target = -1 AND predicted = -1) / count(*) FILTER (WHERE target = -1) AS recall_minus1,
  (count(*) FILTER (WHERE target = -1 AND predicted = -1) / count(*) FILTER (WHERE target = -1) + count(*) FILTER (WHERE target = 1 AND predicted = 1) / count(*) FILTER (WHERE target = 1)) / 2 AS minority_recall_mean,
  1 - avg(abs(uncertainty - abs(prediction - target))) AS calibration_global, avg(CASE WHEN abs(prediction) < 0.3 THEN 1.0 ELSE 0 END) AS hedging_mean, {", ".join(f"{_kappa(f'dimension = {chr(39)}{d}{chr(39)}')} AS hard_{d}" for d in HARD)} FROM mc GROUP BY 1)"""


def _measured(spark, sf):
    """Measures of five runs, each a fifth of the personas."""
    rows = lab._pairs(spark, sf).withColumns({"run": F.col("persona_id") % 5, **{f"_t_{d}": F.when(F.col("dimension") == d, F.col("target")) for d in HARD}, **{f"_p_{d}": F.when(F.col("dimension") == d, F.col("predicted")) for d in HARD}})
    recall = lambda k: met.recall_of("target", "predicted", k)
    gap = F.abs(F.col("uncertainty") - F.abs(F.col("prediction") - F.col("target")))
    return rows.groupBy("run").agg(met.quadratic_kappa("target", "predicted").alias("qwk_mean"), recall(-1).alias("recall_minus1"), ((recall(-1) + recall(1)) / 2).alias("minority_recall_mean"), (1 - F.avg(gap)).alias("calibration_global"),
                                   met.error_measures("prediction", "target")["hedging"].alias("hedging_mean"), *(met.quadratic_kappa(f"_t_{d}", f"_p_{d}").alias(f"hard_{d}") for d in HARD))


_FLOOR_SQL = {"qwk_mean": "qwk_mean + 0.4", "recall_minus1": "recall_minus1 - 0.2", "minority_recall_mean": "minority_recall_mean - 0.24", "calibration_global": "calibration_global - 0.3", "hedging_mean": "0.31 - hedging_mean"}
TEST_FLOORS = {"qwk_mean": -0.4, "recall_minus1": 0.2, "minority_recall_mean": 0.24, "calibration_global": 0.3, "hedging_mean": 0.31}


@plans.add("x35_guardrails", lab.PAIRS + f""", {MEASURES}, g AS (SELECT m.*, {", ".join(f"coalesce({sql} >= 0, false) AS meets_{c}" for c, sql in _FLOOR_SQL.items())}, {", ".join(f"m.hard_{d} - b.hard_{d} AS change_hard_{d}" for d in HARD)}, least({", ".join(_FLOOR_SQL.values()).replace("qwk_mean", "m.qwk_mean").replace("recall_minus1", "m.recall_minus1").replace("minority_recall_mean", "m.minority_recall_mean").replace("calibration_global", "m.calibration_global").replace("hedging_mean", "m.hedging_mean")}) AS least_margin FROM (SELECT * FROM ms) m CROSS JOIN (SELECT {", ".join(f"hard_{d}" for d in HARD)} FROM ms WHERE run = 0) b),
f AS (SELECT *, {" + ".join(f"meets_{c}::INTEGER" for c in _FLOOR_SQL)} AS n_floors, {" AND ".join(f"change_hard_{d} >= -0.02" for d in HARD)} AS no_material_loss, {" OR ".join(f"change_hard_{d} >= 0.05" for d in HARD)} AS required_gain FROM g)
SELECT run, n_floors, no_material_loss, required_gain, round(least_margin, 9) AS least_margin, {", ".join(f"meets_{c}" for c in _FLOOR_SQL)}, {", ".join(f"round(change_hard_{d}, 9) AS change_hard_{d}" for d in HARD)}, row_number() OVER (ORDER BY n_floors DESC, no_material_loss DESC, required_gain DESC, least_margin DESC, qwk_mean DESC, recall_minus1 DESC, minority_recall_mean DESC, hedging_mean, calibration_global DESC, run) AS rank FROM f""", views=True)
def _(spark, sf):
    """Floors, changes of the hard dimensions against the first run, and the order in which runs are chosen."""
    rows = _measured(spark, sf)
    out = ca.guardrails(rows, rows.where("run = 0"), [f"hard_{d}" for d in HARD], TEST_FLOORS)
    return out.select("run", "n_floors", "no_material_loss", "required_gain", F.round("least_margin", 9).alias("least_margin"), *(f"meets_{c}" for c in TEST_FLOORS), *(F.round(f"change_hard_{d}", 9).alias(f"change_hard_{d}") for d in HARD), "rank")


@plans.add("x53_matched_coverage", """WITH t AS (SELECT event_id, dimension, coalesce(score = -1, false) AS c FROM label WHERE is_core),
a AS (SELECT event_id, dimension, r AS repeat, CASE WHEN (event_id + r) % 9 = 0 THEN 'abstain' ELSE verdict END AS a, CASE WHEN (event_id + r) % 5 = 0 THEN 'not_conflict' ELSE verdict END AS b FROM decision CROSS JOIN (VALUES (1), (2), (3)) v(r)),
m AS (SELECT a.*, t.c FROM a JOIN t ON t.event_id = a.event_id AND t.dimension = a.dimension WHERE a <> 'abstain' AND b <> 'abstain')
SELECT repeat, count(*) AS n_matched, count(*) FILTER (WHERE c) AS n_conflict, round(coalesce(count(*) FILTER (WHERE c AND a = 'conflict') / nullif(count(*) FILTER (WHERE c), 0), 0), 9) AS recall_a, round(coalesce(count(*) FILTER (WHERE c AND b = 'conflict') / nullif(count(*) FILTER (WHERE c), 0), 0), 9) AS recall_b, round(count(*) / (SELECT count(*) FROM t), 9) AS coverage FROM m GROUP BY 1""", views=True)
def _(spark, sf):
    truth = adapter.label(spark, sf).where("is_core").select(*CELL, F.coalesce(F.col("score") == -1, F.lit(False)).alias("conflict"))
    rows = adapter.decision(spark, sf).withColumn("repeat", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    k = F.col("event_id") + F.col("repeat")
    arms = rows.select(*CELL, "repeat", F.when(k % 9 == 0, "abstain").otherwise(F.col("verdict")).alias("a"), F.when(k % 5 == 0, "not_conflict").otherwise(F.col("verdict")).alias("b"))
    out = ca.matched_recall(truth, arms, CELL)
    return out.withColumns({c: F.round(c, 9) for c in ("recall_a", "recall_b", "coverage")})


@plans.add("f03_display_name", """WITH v AS (SELECT DISTINCT p_type || '_' || p_brand AS raw FROM part) SELECT raw, array_to_string(list_transform(string_split(lower(replace(raw, '_', ' ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name FROM v""")
def _(spark, sf):
    raw = F.concat_ws("_", "p_type", "p_brand")
    return table(spark, sf, "part").select(raw.alias("raw")).distinct().select("raw", fn.display_name("raw").alias("name"))


@plans.add("b08_simplex_grid", lab.PAIRS + """, g AS (SELECT a / 4 AS w1, b / 4 AS w2, (4 - a - b) / 4 AS w3 FROM range(0, 5) x(a), range(0, 5) y(b) WHERE a + b <= 4),
s AS (SELECT dimension, w1, w2, w3, round(avg(abs(w1 * prediction + w2 * uncertainty + w3 * predicted - target)), 9) AS mae FROM mc CROSS JOIN g GROUP BY ALL)
SELECT dimension, w1, w2, w3, mae FROM s QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY mae, w1 DESC, w2 DESC) = 1""", views=True)
def _(spark, sf):
    """For every dimension the weights of three families, on the simplex grid, whose blend misses the target least."""
    grid = [tuple(r["weights"]) for r in res.simplex_grid(spark, 3, 4).collect()]  # 15 rows
    far = lambda w: F.round(F.avg(F.abs(w[0] * F.col("prediction") + w[1] * F.col("uncertainty") + w[2] * F.col("predicted") - F.col("target"))), 9)
    means = lab._pairs(spark, sf).groupBy("dimension").agg(*(far(w).alias(f"x{k}") for k, w in enumerate(grid)))
    tried = F.array(*(F.struct(F.col(f"x{k}").alias("mae"), F.lit(-w[0]).alias("a"), F.lit(-w[1]).alias("b"), F.lit(w[0]).alias("w1"), F.lit(w[1]).alias("w2"), F.lit(w[2]).alias("w3")) for k, w in enumerate(grid)))
    return means.select("dimension", F.array_min(tried).alias("x")).select("dimension", "x.w1", "x.w2", "x.w3", "x.mae")


def _bundle_sql(rows: str, by: str) -> str:
    """SQL of `metrics.policy_bundle` over rows (target, prediction, predicted, uncertainty)."""
    recall = lambda k: f"count(*) FILTER (WHERE target = {k} AND predicted = {k}) / nullif(count(*) FILTER (WHERE target = {k}), 0)"
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"""er AS (SELECT *, round(abs(prediction - target), 9) AS err FROM ({rows})), rk AS (SELECT *, {rank("uncertainty")} AS ra, {rank("err")} AS rb FROM er),
bd AS (SELECT {by}, count(*) AS n, avg((prediction - target) * (prediction - target)) AS mse, avg(abs(prediction - target)) AS mae, avg(CASE WHEN target = predicted THEN 1.0 ELSE 0 END) AS accuracy, {_kappa()} AS qwk, {recall(-1)} AS recall_minus, {recall(0)} AS recall_zero, {recall(1)} AS recall_plus, ({recall(-1)} + {recall(1)}) / 2 AS minority_recall,
  avg(CASE WHEN abs(prediction) < 0.3 THEN 1.0 ELSE 0 END) AS hedging, count(*) FILTER (WHERE target <> 0 AND predicted <> 0) / nullif(count(*) FILTER (WHERE predicted <> 0), 0) AS activation_precision, count(*) FILTER (WHERE target <> 0 AND predicted <> 0) / nullif(count(*) FILTER (WHERE target <> 0), 0) AS activation_recall,
  count(*) FILTER (WHERE target <> 0 AND target = predicted) / nullif(count(*) FILTER (WHERE target <> 0 AND predicted <> 0), 0) AS sign_accuracy, corr(ra, rb) AS calibration FROM rk GROUP BY {by})
SELECT {by}, n, {", ".join(f"round({c}, 6) AS {c}" for c in BUNDLE)}, CASE WHEN calibration IS NULL THEN 'unknown' WHEN calibration >= 0.3 THEN 'good' WHEN calibration >= 0.1 THEN 'marginal' WHEN calibration >= 0 THEN 'poor' ELSE 'negative' END AS calibration_band FROM bd"""


BUNDLE = ("mse", "mae", "accuracy", "qwk", "recall_minus", "recall_zero", "recall_plus", "minority_recall", "hedging", "activation_precision", "activation_recall", "sign_accuracy", "calibration")


def _six(df):
    return df.withColumns({c: F.round(c, 6) for c in BUNDLE})


@plans.add("x39_policy_bundle", lab.PAIRS + ", " + _bundle_sql("SELECT * FROM mc", "dimension"), views=True)
def _(spark, sf):
    """All measures of a policy by dimension."""
    return _six(met.policy_bundle(lab._pairs(spark, sf), ["dimension"]))


@plans.add("m19_model_by_lens", lab.PAIRS + lab.TALLY.replace("WITH t AS", ", t AS") + ", " + _bundle_sql("SELECT a.model, l.lens, CASE l.lens WHEN 'label' THEN target ELSE con.label END AS target, CASE a.model WHEN 'full' THEN prediction ELSE prediction / 2 END AS prediction, CASE WHEN CASE a.model WHEN 'full' THEN prediction ELSE prediction / 2 END < -0.5 THEN -1 WHEN CASE a.model WHEN 'full' THEN prediction ELSE prediction / 2 END > 0.5 THEN 1 ELSE 0 END AS predicted, uncertainty FROM mc JOIN con ON con.event_id = mc.event_id AND con.dimension = mc.dimension CROSS JOIN (VALUES ('label'), ('consensus')) l(lens) CROSS JOIN (VALUES ('full'), ('timid')) a(model) WHERE mc.dimension = 'security'", "model, lens"), views=True)
def _(spark, sf):
    """Two models under two target lenses, on one dimension, by all measures."""
    consensus = lab.vot.resolve(adapter.vote(spark, sf), CELL).select(*CELL, "label")
    rows = lab._pairs(spark, sf).where("dimension = 'security'").join(consensus, CELL)
    arms = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(lens).alias("lens"), (F.col("prediction") * scale).alias("_p"), F.col(t).alias("_t")) for m, scale in (("full", 1.0), ("timid", 0.5)) for lens, t in (("label", "target"), ("consensus", "label"))))
    rows = rows.select("uncertainty", F.inline(arms)).select("model", "lens", "uncertainty", F.col("_p").alias("prediction"), F.col("_t").alias("target")).withColumn("predicted", fn.discretized("prediction"))
    return _six(met.policy_bundle(rows, ["model", "lens"]))


@plans.add("x36_best_family", lab.PAIRS + f""", fam AS (SELECT *, CASE WHEN uncertainty < -0.5 THEN -1 WHEN uncertainty > 0.5 THEN 1 ELSE 0 END AS b, CASE WHEN prediction * 2 < -0.5 THEN -1 WHEN prediction * 2 > 0.5 THEN 1 ELSE 0 END AS c FROM mc),
ch AS (SELECT dimension, target, CASE WHEN abs(predicted - target) <= abs(b - target) AND abs(predicted - target) <= abs(c - target) THEN 'a' WHEN abs(b - target) <= abs(c - target) THEN 'b' ELSE 'c' END AS family, predicted AS a, b, c FROM fam),
pk AS (SELECT dimension, family, target, CASE family WHEN 'a' THEN a WHEN 'b' THEN b ELSE c END AS predicted FROM ch)
SELECT dimension, count(*) FILTER (WHERE family = 'a') AS n_a, count(*) FILTER (WHERE family = 'b') AS n_b, count(*) FILTER (WHERE family = 'c') AS n_c, round(avg(CASE WHEN target = predicted THEN 1.0 ELSE 0 END), 6) AS accuracy, round({_kappa()}, 6) AS qwk FROM pk GROUP BY 1""", views=True)
def _(spark, sf):
    """The best of three families' classes in every cell (the first of those that tie), and how good that choice is."""
    rows = lab._pairs(spark, sf).select("dimension", "target", F.array(*(F.struct(F.abs(c - F.col("target")).alias("far"), F.lit(k).alias("family"), c.alias("predicted")) for k, c in (("a", F.col("predicted")), ("b", fn.discretized("uncertainty")), ("c", fn.discretized(F.col("prediction") * 2))))).alias("all"))
    rows = rows.select("dimension", "target", F.array_min("all").alias("x")).select("dimension", "target", "x.family", "x.predicted")
    n = lambda k: F.count_if(F.col("family") == k).alias(f"n_{k}")
    return rows.groupBy("dimension").agg(n("a"), n("b"), n("c"), F.round(F.avg((F.col("target") == F.col("predicted")).cast("double")), 6).alias("accuracy"), F.round(met.quadratic_kappa("target", "predicted"), 6).alias("qwk"))


@plans.add("x34_recovered_rows", """WITH r AS (SELECT event_id, dimension, verdict, CASE WHEN event_id % 7 = 0 THEN 'invalid' ELSE review_status END AS status, CASE WHEN event_id % 21 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'entry ' || event_id ELSE 'another' END AS quote, event_id % 35 = 0 AS unparsed FROM decision),
c AS (SELECT *, status = 'invalid' AND NOT unparsed AND CASE WHEN verdict = 'conflict' THEN coalesce(trim(quote) <> '' AND contains('The entry ' || event_id || ' says', quote), false) ELSE verdict IN ('not_conflict', 'abstain') END AS again FROM r)
SELECT event_id, dimension, CASE WHEN again THEN 'ok' ELSE status END AS status, CASE WHEN again THEN 'invalid' END AS recovered_from FROM c""", views=True)
def _(spark, sf):
    """Invalid responses that satisfy the corrected contract: they were parsed, and a conflict quotes the entry."""
    k = F.col("event_id")
    quote = F.when(k % 21 == 0, F.lit(None).cast("string")).when(k % 2 == 0, F.concat(F.lit("entry "), k.cast("string"))).otherwise("another")
    rows = adapter.decision(spark, sf).select(*CELL, "verdict", F.when(k % 7 == 0, "invalid").otherwise(F.col("review_status")).alias("status"), quote.alias("quote"), F.concat(F.lit("The entry "), k.cast("string"), F.lit(" says")).alias("text"), (k % 35 == 0).alias("unparsed"))
    return ca.recovered(rows, ~F.col("unparsed")).select(*CELL, "status", "recovered_from")


@plans.add("x45_trace_rows", f"""WITH e AS (SELECT event_id % 20 AS epoch, dimension, avg(score) AS ce, avg(abs(score)) AS weight, count(*) FILTER (WHERE score = -1) / count(score) AS minus, count(*) FILTER (WHERE score = 0) / count(score) AS zero, count(*) FILTER (WHERE score = 1) / count(score) AS plus FROM label GROUP BY 1, 2),
b AS (SELECT epoch, avg(weight) AS w FROM e GROUP BY 1), s AS (SELECT epoch FROM b ORDER BY round(w, 9) DESC, epoch LIMIT 1)
SELECT e.epoch, dimension, round(ce, 9) AS train_ce_mean, round(weight, 9) AS applied_weight, round(minus, 9) AS val_recall_minus1, round(zero, 9) AS val_recall_zero, round(plus, 9) AS val_recall_plus1, e.epoch % 3 <> 0 AS eligible, e.epoch = s.epoch AS selected FROM e, s""", views=True)
def _(spark, sf):
    """One row per epoch and dimension of epochs' vectors, the selected epoch marked."""
    share = lambda k: F.count_if(F.col("score") == k) / F.count("score")
    cells = adapter.label(spark, sf).groupBy((F.col("event_id") % 20).alias("epoch"), "dim_index").agg(F.avg("score").alias("ce"), F.avg(F.abs("score")).alias("weight"), F.struct(share(-1).alias("minus1"), share(0).alias("zero"), share(1).alias("plus1")).alias("recall"))
    vector = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("dim_index", c))), lambda x: x[c]).alias(c)
    epochs = cells.groupBy("epoch").agg(vector("ce"), vector("weight"), vector("recall"), F.avg("weight").alias("mean")).select("epoch", F.col("ce").alias("train_ce_mean"), F.col("weight").alias("applied_weight"), "recall", (F.col("epoch") % 3 != 0).alias("eligible"), "mean")
    best = epochs.orderBy(F.desc(F.round("mean", 9)), "epoch").first()
    out = ca.dimension_trace(epochs, ["train_ce_mean", "applied_weight"], DIMS, best["epoch"] if best else None)
    return out.withColumns({c: F.round(c, 9) for c in ("train_ce_mean", "applied_weight", "val_recall_minus1", "val_recall_zero", "val_recall_plus1")})


@plans.add("t13_lifecycle", """WITH e AS (SELECT event_id, ['complete', 'reused', 'refused', 'invalid', 'failed', 'queued', 'running', 'lost'][1 + event_id % 8] AS status, ts AS started, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 11 = 3 THEN ts - INTERVAL 1 SECOND ELSE ts + INTERVAL 1 SECOND END END AS ended, CASE WHEN event_id % 7 <> 0 THEN 5 END AS ms, CASE WHEN event_id % 3 = 0 THEN 'x' END AS error, CASE event_id % 4 WHEN 0 THEN true WHEN 3 THEN event_id % 16 = 3 END AS valid FROM events),
p AS (SELECT event_id, unnest([CASE WHEN status = 'lost' THEN 'unknown status' END, CASE WHEN status IN ('complete', 'reused', 'refused', 'invalid', 'failed') AND (ended IS NULL OR ms IS NULL) THEN 'no completion timing' END, CASE WHEN status IN ('complete', 'reused', 'refused', 'invalid', 'failed') AND ended < started THEN 'completion precedes start' END,
  CASE WHEN status IN ('queued', 'running') AND (ended IS NOT NULL OR ms IS NOT NULL) THEN 'complete before the end' END, CASE WHEN status IN ('refused', 'invalid', 'failed') AND error IS NULL THEN 'no error' END, CASE WHEN status IN ('complete', 'reused') AND error IS NOT NULL THEN 'error of a success' END, CASE WHEN status = 'invalid' AND coalesce(valid, true) THEN 'no failed validation' END]) AS problem FROM e)
SELECT * FROM p WHERE problem IS NOT NULL""")
def _(spark, sf):
    """Events that break their lifecycle."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (*live.TERMINAL, "queued", "running", "lost"))), (k % 8 + 1).cast("int"))
    second = F.expr("interval 1 second")
    ended = F.when(k % 5 != 0, F.when(k % 11 == 3, F.col("ts") - second).otherwise(F.col("ts") + second))
    rows = table(spark, sf, "events").select("event_id", status.alias("status"), F.col("ts").alias("started_at"), ended.alias("completed_at"), F.when(k % 7 != 0, 5).alias("duration_ms"), F.when(k % 3 == 0, "x").alias("error"), F.when(k % 4 == 0, True).when(k % 4 == 3, k % 16 == 3).alias("valid"))
    return live.lifecycle_problems(rows)


@plans.add("t13_session_problems", """WITH s AS (SELECT DISTINCT persona_id AS id FROM entry), n AS (SELECT persona_id, t_index, CASE WHEN event_id % 211 = 5 THEN t_index - 1 ELSE t_index END AS t FROM entry),
b AS (SELECT persona_id, bool_or(coalesce(t <= p, false)) AS back FROM (SELECT *, lag(t) OVER (PARTITION BY persona_id ORDER BY t_index) AS p FROM n) GROUP BY 1), l AS (SELECT persona_id, arg_max(d, t_index) AS last, bool_or(event_id % 97 = 11) AS twice FROM entry GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS session_id, 'profile of another session' AS problem FROM s WHERE id % 6 = 1 UNION ALL SELECT CAST(persona_id AS VARCHAR), 'positions not unique and ascending' FROM b WHERE back
UNION ALL SELECT CAST(persona_id AS VARCHAR), 'clock precedes entries' FROM l WHERE persona_id % 5 = 2 UNION ALL SELECT CAST(persona_id AS VARCHAR), 'event ids not unique' FROM l WHERE twice""", views=True)
def _(spark, sf):
    """Sessions whose profile, positions, clock or event ids don't fit."""
    e = adapter.entry(spark, sf).withColumn("session_id", F.col("persona_id").cast("string"))
    p, k = F.col("persona_id"), F.col("event_id")
    rows = e.groupBy("session_id", "persona_id").agg(F.max_by("d", "t_index").alias("last"))
    rows = rows.select("session_id", F.when(p % 6 == 1, "other").otherwise(F.col("session_id")).alias("profile_session_id"), F.when(p % 5 == 2, F.date_sub("last", 1)).when(p % 5 == 3, F.col("last")).alias("clock"))
    entries = e.select("session_id", F.col("t_index").alias("place"), F.when(k % 211 == 5, F.col("t_index") - 1).otherwise(F.col("t_index")).alias("t_index"), F.col("d").alias("date"))
    ids = e.select("session_id", F.explode(F.when(k % 97 == 11, F.array(k, k)).otherwise(F.array(k))).alias("event_id"))
    return live.session_problems(rows, entries, ids)


# Early reviews: some weeks of some personas, at half of the week's entries; their labels follow another whole-number rule.

EARLY = """cs AS (SELECT persona_id, dimension, t_index, d, event_id, CAST(date_trunc('week', d) AS DATE) AS week, CASE WHEN review_status <> 'ok' OR verdict = 'abstain' THEN NULL ELSE verdict = 'conflict' END AS label, CASE WHEN (event_id * 3 + dim_index) % 7 = 0 THEN NULL ELSE (event_id * 3 + dim_index) % 7 < 5 END AS early FROM decision),
rec AS (SELECT persona_id, week, persona_id || ':' || week AS record_id, CAST(min(t_index) + (max(t_index) - min(t_index)) // 2 AS BIGINT) AS cutoff, CAST(week + CAST(persona_id % 3 AS INTEGER) + 2 AS DATE) AS review_at FROM cs WHERE (persona_id + day(week)) % 3 <> 0 GROUP BY 1, 2)"""


def _early(spark, sf):
    v = F.col("verdict")
    rule = (F.col("event_id") * 3 + F.col("dim_index")) % 7
    rows = adapter.decision(spark, sf).withColumn("week_start", _week("d"))
    weekly = rows.withColumn("label", F.when((F.col("review_status") == "ok") & (v != "abstain"), v == "conflict"))
    early = rows.withColumn("label", F.when(rule != 0, rule < 5)).select(*CORE, "t_index", "label")
    p, low, high = F.col("persona_id"), F.min("t_index"), F.max("t_index")
    records = rows.where((p + F.dayofmonth("week_start")) % 3 != 0).groupBy("persona_id", "week_start").agg((low + F.floor((high - low) / 2)).alias("cutoff"))
    records = records.select("persona_id", "week_start", F.concat_ws(":", p.cast("string"), F.col("week_start").cast("string")).alias("record_id"), "cutoff", F.date_add("week_start", (p % 3).cast("int") + 2).alias("review_at"))
    return epi.scheduled_episodes(weekly, early, records)


_SNAPSHOTS = """snap AS (SELECT r.record_id, r.review_at, r.cutoff, c.persona_id, c.dimension, c.t_index, CASE WHEN c.week = r.week THEN c.early ELSE c.label END AS l FROM rec r JOIN cs c ON c.persona_id = r.persona_id AND c.t_index <= r.cutoff),
es AS (SELECT persona_id, dimension, review_at AS alert, min(t_index) AS onset, max(t_index) AS fin FROM (SELECT *, t_index - row_number() OVER (PARTITION BY record_id, persona_id, dimension ORDER BY t_index) AS g FROM snap WHERE l) GROUP BY record_id, persona_id, dimension, review_at, g HAVING count(*) >= 2),
ws AS (SELECT persona_id, dimension, min(t_index) AS onset, max(t_index) AS fin FROM (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM cs WHERE label) GROUP BY persona_id, dimension, g HAVING count(*) >= 2),
sp AS (SELECT persona_id || '|' || dimension AS case_id, alert, onset, fin FROM es UNION ALL SELECT ws.persona_id || '|' || ws.dimension, CAST(c.week + 7 AS DATE), onset, fin FROM ws JOIN cs c ON c.persona_id = ws.persona_id AND c.dimension = ws.dimension AND c.t_index = ws.onset + 1),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY alert, onset, fin) AS i FROM sp),
g AS (SELECT case_id, i, [{'alert': alert, 'onset': onset, 'fin': fin}] AS kept FROM o WHERE i = 1 UNION ALL
  SELECT case_id, i, CASE WHEN coalesce(h, 0) = 0 THEN list_append(kept, {'alert': alert, 'onset': onset, 'fin': fin}) ELSE list_transform(kept, lambda x, j: CASE WHEN j = h THEN {'alert': x.alert, 'onset': x.onset, 'fin': greatest(x.fin, fin)} ELSE x END) END
  FROM (SELECT o.case_id, o.i, o.alert, o.onset, o.fin, g.kept, list_position(list_transform(g.kept, lambda x: o.onset <= x.fin AND o.fin >= x.onset), true) AS h FROM g JOIN o ON o.case_id = g.case_id AND o.i = g.i + 1)),
z AS (SELECT case_id, unnest(arg_max(kept, i)) AS x FROM g GROUP BY 1)"""


@plans.add("x31_scheduled_episodes", _recursive(f"WITH RECURSIVE {EARLY}, {_SNAPSHOTS} SELECT CAST(split_part(case_id, '|', 1) AS BIGINT) AS persona_id, split_part(case_id, '|', 2) AS dimension, x.alert AS alert, x.onset AS onset, x.fin AS \"end\" FROM z"))
def _(spark, sf):
    """Weekly and scheduled reviews' episodes merged; the SQL makes every review's whole snapshot."""
    return _early(spark, sf)[0]


@plans.add("x31_scheduled_coverage", f"""WITH {EARLY}, k AS (SELECT c.*, coalesce(c.label, CASE WHEN r.record_id IS NOT NULL THEN c.early END) AS l FROM cs c LEFT JOIN rec r ON r.persona_id = c.persona_id AND r.week = c.week AND c.t_index <= r.cutoff),
n AS (SELECT persona_id, dimension, l, lead(l) OVER w AS nl, lead(t_index) OVER w = t_index + 1 AS near FROM k WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index))
SELECT persona_id, dimension, coalesce(bool_or(l AND nl) FILTER (WHERE near), false) OR coalesce(bool_and(coalesce(NOT l, false) OR coalesce(NOT nl, false)) FILTER (WHERE near), false) AS covered FROM n GROUP BY 1, 2""", views=True)
def _(spark, sf):
    return _early(spark, sf)[1]


@plans.add("f62_text_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL), w AS (SELECT *, len([x FOR x IN regexp_split_to_array(value, '[ \t\n\x0B\f\r]+') IF x <> '']) AS n FROM l)
SELECT doc_id, count(*) AS n_lines, max(line) AS last_line, CAST(sum(n) AS BIGINT) AS n_words, max(n) AS longest FROM w WHERE n > 0 GROUP BY 1""")
def _(spark, sf):
    """Lines of every text by a table function that is joined laterally."""
    tables.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_documents_of_lines")
    return spark.sql("SELECT doc_id, count(*) AS n_lines, max(line) AS last_line, sum(n_words) AS n_words, max(n_words) AS longest FROM _documents_of_lines, LATERAL text_lines(text) GROUP BY doc_id")
