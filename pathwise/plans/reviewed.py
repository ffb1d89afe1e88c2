"""Queries of reviewed cases, passes, digests and surveys (survey rows V13, X13, X15, X16, X25-X27, X29, S15, S19, S20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise import adapter
from pathwise.adapter import table
from pathwise.operators import reviewed as rev
from pathwise.operators import sequence as seq
from pathwise.plans.base import Plans
from pathwise.plans.sequence import CORE, GREEDY, REFERENCE, _recursive
from pathwise.schema import DIMS
from pathwise.session import checkpointed
from pathwise.sources import readers

plans = Plans()
SPLITS = "CASE {0} % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'retired' END"


@plans.add("x13_split_tier", f"SELECT o_orderkey, CASE WHEN a = b THEN 0 WHEN a <> 'retired' AND b <> 'retired' THEN 1 ELSE 2 END AS tier FROM (SELECT o_orderkey, {SPLITS.format('o_orderkey')} AS a, {SPLITS.format('o_custkey')} AS b FROM orders)")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", rev.split_match_tier(F.expr(SPLITS.format("o_orderkey")), F.expr(SPLITS.format("o_custkey"))).alias("tier"))


FLIPS = """SELECT dimension, CAST(max(n) AS BIGINT) AS max_path_flip, CASE WHEN max(n) % 3 = 0 THEN 'stable' WHEN max(n) % 3 = 1 THEN 'ambiguous' ELSE 'unstable' END AS max_path_band, max(n) // 40 AS n_unrecoverable, max(n) // 10 AS n_reduced
  FROM (SELECT dimension, persona_id % 3 AS path, count(*) FILTER (WHERE score IS NULL) % 5 AS n FROM label GROUP BY 1, 2) GROUP BY 1"""


@plans.add("x15_recommendation", f"""WITH f AS ({FLIPS}), g AS (SELECT *, CASE WHEN max_path_flip >= 4 OR n_unrecoverable >= 2 THEN 2 WHEN max_path_band = 'ambiguous' OR n_reduced >= 2 THEN 1 ELSE 0 END AS k FROM f)
SELECT dimension, ['keep_current_labels', 'targeted_relabeling', 'change_distillation_target'][k + 1] AS recommendation, ['keep_current_labels', 'targeted_relabeling', 'change_distillation_target'][max(k) OVER () + 1] AS overall FROM g""", views=True)
def _(spark, sf):
    n = adapter.label(spark, sf).groupBy("dimension", (F.col("persona_id") % 3).alias("path")).agg((F.count_if(F.col("score").isNull()) % 5).alias("n")).groupBy("dimension").agg(F.max("n").alias("n"))
    k = F.col("n")
    band = F.when(k % 3 == 0, "stable").when(k % 3 == 1, "ambiguous").otherwise("unstable")
    rows = n.select("dimension", k.alias("max_path_flip"), band.alias("max_path_band"), F.floor(k / 40).alias("n_unrecoverable"), F.floor(k / 10).alias("n_reduced"))
    return rev.recommendations(rows).select("dimension", "recommendation", "overall")


def _passes(spark, sf):
    """A pass's scores per entry, with rationales for most of those that are not 0; passes 4 and 5 say the same."""
    again = F.when(F.col("pass") == 4, F.array(F.lit(4), F.lit(5))).otherwise(F.array("pass"))
    rows = adapter.pass_scores(spark, sf).where("pass < 5").select("persona_id", "event_id", "scores", F.explode(again).alias("pass"))
    told = (F.col("event_id") % 97 != 0) | (F.col("pass") != 2)
    why = F.transform_values(F.map_filter("scores", lambda d, s: (s != 0) & told), lambda d, s: F.lit("why"))
    return rows.select("persona_id", "pass", "event_id", "scores", why.alias("rationales"))


VECTORS = """q AS (SELECT * FROM vote WHERE pass < 5 UNION ALL SELECT * REPLACE (5 AS pass) FROM vote WHERE pass = 4),
r AS (SELECT pass, event_id, string_agg(score, ',' ORDER BY dim_index) AS vector, count(*) FILTER (WHERE score <> 0) AS n, count(*) FILTER (WHERE score <> 0 AND (event_id % 97 <> 0 OR pass <> 2)) AS told FROM q GROUP BY 1, 2),
p AS (SELECT pass, count(*) AS n_rows, concat_ws('-', sum(CAST('0x' || substr(md5(event_id || '|' || vector), 1, 10) AS BIGINT)), sum(CAST('0x' || substr(md5(event_id || '|' || vector), 11, 10) AS BIGINT)), sum(CAST('0x' || substr(md5(event_id || '|' || vector), 21, 10) AS BIGINT))) AS score_hash, CAST(sum(n) AS BIGINT) AS n_scores, CAST(sum(told) AS BIGINT) AS n_rationales FROM r GROUP BY 1)"""


@plans.add("v13_pass_provenance", f"WITH {VECTORS} SELECT * FROM p", views=True)
def _(spark, sf):
    return rev.provenance(_passes(spark, sf))


@plans.add("v13_pass_similarity", f"WITH {VECTORS} SELECT x.pass AS a, y.pass AS b, count(*) AS n_shared, count(*) FILTER (WHERE x.vector <> y.vector) AS n_differ, any_value(px.score_hash = py.score_hash) AS hash_match FROM r x JOIN r y ON x.event_id = y.event_id AND x.pass < y.pass JOIN p px ON px.pass = x.pass JOIN p py ON py.pass = y.pass GROUP BY 1, 2", views=True)
def _(spark, sf):
    rows = _passes(spark, sf)
    vector = rows.select("persona_id", "pass", "event_id", rev.score_vector("scores").alias("vector"))
    now = checkpointed(rev.provenance(rows))  # five rows that are read twice
    return rev.pass_similarity(vector, now, item=["persona_id", "event_id"])


@plans.add("v13_shard_problems", "WITH s AS (SELECT pass, event_id FROM (SELECT DISTINCT pass, event_id FROM vote) WHERE (event_id + pass) % 29 <> 0 UNION ALL SELECT pass, event_id FROM (SELECT DISTINCT pass, event_id FROM vote) WHERE event_id % 31 = pass UNION ALL SELECT 1, -event_id FROM events WHERE event_id % 50 = 0), c AS (SELECT pass, event_id, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT DISTINCT pass, event_id FROM vote) SELECT coalesce(c.pass, a.pass) AS pass, coalesce(c.event_id, a.event_id) AS event_id, CASE WHEN a.pass IS NULL THEN 'extra' WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM c FULL JOIN a ON a.pass = c.pass AND a.event_id = c.event_id WHERE a.pass IS NULL OR n IS NULL OR n > 1", views=True)
def _(spark, sf):
    asked = adapter.vote(spark, sf).select("pass", "event_id").distinct()
    shards = asked.where("(event_id + pass) % 29 <> 0").unionByName(asked.where("event_id % 31 = pass")).unionByName(table(spark, sf, "events").where("event_id % 50 = 0").select(F.lit(1).alias("pass"), (-F.col("event_id")).alias("event_id")))
    return rev.merge_passes(shards, asked)[1]


@plans.add("x16_provenance_problems", f"WITH {VECTORS} SELECT 2 AS pass, 'rationales are missing' AS problem UNION ALL SELECT 3, 'n_scores differs' UNION ALL SELECT 1, 'no provenance' UNION ALL SELECT 6, 'no results' UNION ALL SELECT pass, 'same scores as another pass' FROM (SELECT pass, count(*) OVER (PARTITION BY score_hash) AS k FROM p) WHERE k > 1", views=True)
def _(spark, sf):
    now = checkpointed(rev.provenance(_passes(spark, sf)))  # five rows that are read four times
    stored = now.where("pass > 1").withColumn("n_scores", F.col("n_scores") + (F.col("pass") == 3).cast("int"))
    return rev.provenance_problems(stored.unionByName(now.where("pass = 1").withColumn("pass", F.lit(6))), now)


QUOTED = "CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN ' said ' || event_id || ' ' END"
TEXT = "CASE WHEN event_id % 5 <> 0 THEN 'text ' || event_id ELSE '' END"


@plans.add("x25_evidence", f"""SELECT persona_id, t_index, dimension, direction, excerpt FROM (SELECT persona_id, t_index, dimension, CASE WHEN verdict = 'conflict' THEN 'misaligned' ELSE 'context' END AS direction, coalesce(CASE WHEN verdict = 'conflict' THEN nullif(trim({QUOTED}), '') END, nullif({TEXT}, '')) AS excerpt, row_number() OVER (PARTITION BY persona_id ORDER BY t_index DESC, dim_index DESC) AS i FROM decision) WHERE i <= 3 AND excerpt IS NOT NULL""", views=True)
def _(spark, sf):
    rows = adapter.decision(spark, sf).withColumns({"quote": F.expr(QUOTED), "text": F.expr(TEXT)})
    return rev.evidence_snippets(rows).select("persona_id", "t_index", "dimension", "direction", "excerpt")


def _rankings(spark, sf):
    """Per persona its dimensions by mean score, and signals of every third one."""
    means = adapter.label(spark, sf).where("score is not null").groupBy("persona_id", "dim_index", "dimension").agg(F.sum("score").alias("total"))
    ranked = F.sort_array(F.collect_list(F.struct("total", "dim_index", "dimension")))
    trigger = F.element_at(F.array(*map(F.lit, ("crash", "evolution", "rut", "acknowledgement"))), (F.col("dim_index") % 4 + 1).cast("int"))
    signals = F.sort_array(F.collect_list(F.when((F.col("dim_index") + F.col("persona_id")) % 3 == 0, F.struct("dim_index", "dimension", F.col("total").alias("mean"), trigger.alias("trigger")))))
    return means.groupBy("persona_id").agg(ranked.alias("r"), signals.alias("signals")).withColumn("ranked", F.col("r.dimension"))


MEANS = "m AS (SELECT persona_id, dim_index, dimension, sum(score) AS total FROM label WHERE score IS NOT NULL GROUP BY 1, 2, 3)"


@plans.add("x26_prioritized", f"""WITH {MEANS}, o AS (SELECT *, CASE WHEN (dim_index + persona_id) % 3 = 0 AND total < 0 AND dim_index % 4 IN (0, 1, 2) THEN 0 ELSE 1 END AS tier FROM m)
SELECT persona_id, string_agg(dimension, ',' ORDER BY tier, CASE WHEN tier = 0 THEN dim_index ELSE total END, dim_index) AS dimensions FROM o GROUP BY 1""", views=True)
def _(spark, sf):
    return _rankings(spark, sf).select("persona_id", F.array_join(rev.prioritized("ranked", "signals", "tension"), ",").alias("dimensions"))


@plans.add("x27_row_dimensions", f"""WITH {MEANS}, o AS (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY total, dim_index) AS lo, row_number() OVER (PARTITION BY persona_id ORDER BY total DESC, dim_index) AS hi FROM m)
SELECT persona_id, string_agg(dimension, ',' ORDER BY lo) FILTER (WHERE (total < 0 AND lo <= 2) OR lo = 1) AS misaligned, string_agg(dimension, ',' ORDER BY hi) FILTER (WHERE (total > 0 AND hi <= 2) OR hi = 1) AS aligned FROM o GROUP BY 1""", views=True)
def _(spark, sf):
    means = adapter.label(spark, sf).where("score is not null").groupBy("persona_id", "dim_index", "dimension").agg(F.sum("score").alias("score"))
    rows = means.groupBy("persona_id").agg(F.sort_array(F.collect_list(F.struct("dim_index", "dimension", "score"))).alias("scored"))
    return rows.select("persona_id", F.array_join(rev.row_dimensions("scored", "misaligned"), ",").alias("misaligned"), F.array_join(rev.row_dimensions("scored", "aligned"), ",").alias("aligned"))


STATES = "['active_drift', 'insufficient_evidence', 'no_active_drift', 'no_active_drift'][1 + dim_index % 4]"


@plans.add("x29_digest_policy", f"""WITH s AS (SELECT persona_id, list(CASE WHEN score = -1 AND event_id % 7 = 0 THEN 'active_drift' WHEN score IS NULL AND event_id % 5 = 0 THEN 'insufficient_evidence' ELSE 'no_active_drift' END) AS states, CASE persona_id % 3 WHEN 0 THEN 'rut' WHEN 1 THEN 'stable' END AS mode FROM label WHERE is_core GROUP BY 1)
SELECT persona_id, CASE WHEN list_contains(states, 'active_drift') THEN 'drift_detected' WHEN list_contains(states, 'insufficient_evidence') OR mode = 'rut' THEN 'more_reflection_needed' ELSE 'no_current_drift' END AS policy FROM s""", views=True)
def _(spark, sf):
    state = F.when((F.col("score") == -1) & (F.col("event_id") % 7 == 0), "active_drift").when(F.col("score").isNull() & (F.col("event_id") % 5 == 0), "insufficient_evidence").otherwise("no_active_drift")
    rows = adapter.label(spark, sf).where("is_core").groupBy("persona_id").agg(F.collect_set(state).alias("states"))
    mode = F.when(F.col("persona_id") % 3 == 0, "rut").when(F.col("persona_id") % 3 == 1, "stable")
    return rows.select("persona_id", rev.digest_policy("states", mode).alias("policy"))


def _responses(spark, sf):
    """An order's first lines as survey responses: set = line number, six items of the set, some of them off."""
    k, s = F.col("l_orderkey"), F.col("l_linenumber")
    items = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("i"), s, F.lit("-"), F.when((k % 23 == 0) & (i == 5), F.lit(0)).otherwise(i)))
    pick = lambda n: F.concat(F.lit("i"), s, F.lit("-"), n)
    rows = table(spark, sf, "lineitem").select(k.alias("session_id"), F.when(k % 29 == 0, F.lit(1)).otherwise(s).alias("set_number"), items.alias("items"), items.alias("item_order_shown"), pick(k % 6).alias("selected_best"), pick((k * 5 + 1) % 6).alias("selected_worst"), F.when(k % 37 == 0, -1).otherwise(100).alias("response_time_ms"))
    sets = spark.range(1, 7).select(F.col("id").cast("int").alias("set_number"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.lit("i"), F.col("id"), F.lit("-"), i)).alias("prescribed"))
    return rows, sets


@plans.add("s20_survey_problems", """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS s, CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE l_linenumber END AS n FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY k, n) AS same FROM r),
p AS (SELECT k, n, CASE WHEN n > 6 THEN 'unknown set' WHEN k % 23 = 0 OR s <> n THEN 'other items than prescribed' WHEN k % 6 = (k * 5 + 1) % 6 THEN 'choices are not two of the items' WHEN k % 37 = 0 THEN 'response time' WHEN same > 1 THEN 'repeated set' END AS problem FROM c)
SELECT k AS session_id, n AS set_number, problem FROM p WHERE problem IS NOT NULL UNION ALL SELECT k, NULL, 'sets are missing' FROM r GROUP BY k HAVING count(DISTINCT n) < 6""")
def _(spark, sf):
    return rev.survey_problems(*_responses(spark, sf))


@plans.add("s15_rater_union", "SELECT 'a' AS run_id, count(*) AS n FROM nation UNION ALL SELECT 'c', count(*) FROM region")
def _(spark, sf):
    runs = readers.readable_runs(spark, {"a": f"{sf}/nation.parquet", "b": f"{sf}/no-such-table.parquet", "c": f"{sf}/region.parquet"})
    return runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@plans.add("s19_frozen_load", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    frozen = {"orders": {"path": f"{sf}/orders.parquet", "rows": o.count(), "complete": ("o_custkey", "customer", "c_custkey")}, "customer": {"path": f"{sf}/customer.parquet"}}
    loaded = readers.load_frozen(spark, frozen)
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in loaded.items()]
    return counts[0].unionByName(counts[1])


def _reference(spark, sf):
    """Reference episodes with the dates of their onset and confirmation."""
    label = adapter.label(spark, sf).where("is_core")
    days = label.select(*CORE, "t_index", "d")
    ref = seq.reference_episodes(label)
    at = lambda c, name: days.withColumnsRenamed({"t_index": c, "d": name})
    return ref.join(at("onset_t_index", "onset_d"), [*CORE, "onset_t_index"]).join(at("confirmation_t_index", "confirmation_d"), [*CORE, "confirmation_t_index"])


PAIR_VERDICTS = """nx AS (SELECT persona_id, dimension, t_index, verdict AS a, review_status, lead(verdict) OVER w AS b, lead(t_index) OVER w AS nt, lead(review_status) OVER w AS nr FROM decision WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
pv AS (SELECT persona_id, dimension, t_index, CASE WHEN a = 'abstain' OR b = 'abstain' THEN 'abstain' WHEN a = 'conflict' AND b = 'conflict' THEN 'yes' ELSE 'no' END AS decision FROM nx WHERE nt = t_index + 1),
yr AS (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM pv WHERE decision = 'yes'),
pred AS (SELECT persona_id || '::' || dimension || '::' || min(t_index) AS episode_id, persona_id, dimension, min(t_index) + 1 AS confirmation_t_index, 'yes' AS delivery_state FROM yr GROUP BY persona_id, dimension, g),"""


@plans.add("x51_pair_metrics", _recursive("WITH RECURSIVE " + REFERENCE.strip().removeprefix("WITH").strip() + ", " + PAIR_VERDICTS + GREEDY + """,
rd AS (SELECT r.*, date_trunc('week', a.d) = date_trunc('week', b.d) AS same, m.predicted_episode_id IS NOT NULL AS hit FROM ref r JOIN entry a ON a.persona_id = r.persona_id AND a.t_index = r.onset_t_index JOIN entry b ON b.persona_id = r.persona_id AND b.t_index = r.confirmation_t_index LEFT JOIN matched m ON m.reference_episode_id = r.episode_id),
cv AS (SELECT count(*) AS n_cases, count(*) FILTER (WHERE coalesce(c, false)) AS n_covered FROM (SELECT DISTINCT persona_id, dimension FROM label WHERE is_core) k LEFT JOIN (SELECT persona_id, dimension, bool_or(decision = 'yes') OR bool_and(decision = 'no') AS c FROM pv GROUP BY 1, 2) v ON v.persona_id = k.persona_id AND v.dimension = k.dimension),
o AS (SELECT count(*) AS n_reference, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE same) AS same_week_reference, count(*) FILTER (WHERE same AND hit) AS same_week_hits, count(*) FILTER (WHERE NOT same) AS cross_week_reference, count(*) FILTER (WHERE NOT same AND hit) AS cross_week_hits FROM rd)
SELECT o.*, cv.*, (SELECT count(*) FROM pred) AS n_predicted, round(hits / (SELECT count(*) FROM pred), 6) AS precision, round(hits / n_reference, 6) AS recall, round(n_covered / n_cases, 6) AS coverage FROM o, cv"""))
def _(spark, sf):
    d = adapter.decision(spark, sf)
    a, b = F.col("verdict"), F.col("next_verdict")
    decision = F.when((a == "abstain") | (b == "abstain"), "abstain").when((a == "conflict") & (b == "conflict"), "yes").otherwise("no")
    pairs = seq.adjacent_pairs(d, columns=("verdict",)).select(*CORE, "t_index", decision.alias("decision"))
    out = rev.pair_metrics(_reference(spark, sf), pairs, adapter.label(spark, sf).where("is_core"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "coverage")})


RUN_LABELS = """rl AS (SELECT persona_id * 10 + run AS persona_id, dimension, t_index, d, review_status = 'ok' AND (event_id + run) % 9 <> 0 AS ok, CASE WHEN review_status <> 'ok' OR verdict = 'abstain' OR (event_id + run) % 9 = 0 THEN NULL ELSE verdict = 'conflict' END AS l FROM decision CROSS JOIN (VALUES (1), (2), (3)) v(run)),
rt AS (SELECT *, t_index - row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS g FROM rl WHERE l),
pred AS (SELECT persona_id || '::' || dimension || '::' || min(t_index) AS episode_id, persona_id, dimension, min(t_index) + 1 AS confirmation_t_index, 'drift' AS delivery_state FROM rt GROUP BY persona_id, dimension, g HAVING count(*) >= 2),"""


@plans.add("x20_case_metrics", _recursive("WITH RECURSIVE " + REFERENCE.strip().removeprefix("WITH").strip().replace("ref AS (", "ref0 AS (") + """, ref AS (SELECT r.* REPLACE (r.persona_id * 10 + v.run AS persona_id, (r.persona_id * 10 + v.run) || r.episode_id AS episode_id) FROM ref0 r CROSS JOIN (VALUES (1), (2), (3)) v(run)), """ + RUN_LABELS + GREEDY + """,
days AS (SELECT persona_id, t_index, d FROM entry),
delay AS (SELECT m.persona_id, m.dimension, count(*) AS hits, median(latency_entries) AS median_delay_entries, median(date_diff('day', b.d, CAST(date_trunc('week', a.d) AS DATE) + 7)) AS median_delay_days FROM matched m JOIN days a ON a.persona_id = m.persona_id // 10 AND a.t_index = m.predicted_confirmation JOIN days b ON b.persona_id = m.persona_id // 10 AND b.t_index = m.reference_confirmation GROUP BY 1, 2),
pr AS (SELECT persona_id, dimension, l, lead(l) OVER w AS nl, lead(t_index) OVER w = t_index + 1 AS near FROM rl WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
cov AS (SELECT persona_id, dimension, coalesce(bool_or(l AND nl) FILTER (WHERE near), false) OR coalesce(bool_and(coalesce(NOT l, false) OR coalesce(NOT nl, false)) FILTER (WHERE near), false) AS covered FROM pr GROUP BY 1, 2),
resp AS (SELECT persona_id, dimension, count(*) FILTER (WHERE ok) AS valid_responses, count(*) FILTER (WHERE NOT ok) AS invalid_responses FROM (SELECT persona_id, dimension, date_trunc('week', d) AS wk, bool_and(ok) AS ok FROM rl GROUP BY 1, 2, 3) GROUP BY 1, 2),
nr AS (SELECT persona_id, dimension, count(*) AS n FROM ref GROUP BY 1, 2), np AS (SELECT persona_id, dimension, count(*) AS n FROM pred GROUP BY 1, 2)
SELECT 'plain' AS setup, CAST(k.persona_id % 10 AS INTEGER) AS repeat, k.persona_id // 10 AS persona_id, k.dimension, coalesce(nr.n, 0) AS n_reference, coalesce(np.n, 0) AS n_predicted, coalesce(y.hits, 0) AS hits, median_delay_entries, median_delay_days, c.covered, valid_responses, invalid_responses,
  coalesce(nr.n, 0) - coalesce(y.hits, 0) AS missed, coalesce(np.n, 0) - coalesce(y.hits, 0) AS false_alerts
FROM (SELECT DISTINCT persona_id, dimension FROM rl) k LEFT JOIN nr ON nr.persona_id = k.persona_id AND nr.dimension = k.dimension LEFT JOIN np ON np.persona_id = k.persona_id AND np.dimension = k.dimension LEFT JOIN delay y ON y.persona_id = k.persona_id AND y.dimension = k.dimension
  JOIN cov c ON c.persona_id = k.persona_id AND c.dimension = k.dimension JOIN resp q ON q.persona_id = k.persona_id AND q.dimension = k.dimension"""))
def _(spark, sf):
    d = adapter.decision(spark, sf)
    run = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("repeat")
    off = (F.col("event_id") + F.col("repeat")) % 9 == 0
    rows = d.select("*", F.lit("plain").alias("setup"), run).withColumns({"ok": (F.col("review_status") == "ok") & ~off})
    rows = rows.withColumn("label", F.when(F.col("ok") & (F.col("verdict") != "abstain"), F.col("verdict") == "conflict"))
    keys = ("setup", "repeat", *CORE)
    spans = seq.drift_spans(rows, F.coalesce(F.col("label"), F.lit(False)), keys)
    days = rows.select(*keys, F.col("t_index").alias("confirmation_t_index"), F.date_add(F.date_trunc("week", "d").cast("date"), 7).alias("detection_d"))
    predicted = spans.select(*keys, F.concat_ws("::", *(F.col(k).cast("string") for k in keys), F.col("onset").cast("string")).alias("episode_id"), F.col("onset").alias("onset_t_index"), F.col("confirmation").alias("confirmation_t_index"), F.lit("drift").alias("delivery_state")).join(days, [*keys, "confirmation_t_index"])
    weeks = rows.groupBy(*keys, F.date_trunc("week", "d").alias("week")).agg(F.bool_and("ok").alias("ok"))
    return rev.case_metrics(rows, _reference(spark, sf), predicted, seq.coverage(rows, keys=keys), weeks)
