"""Weekly aggregation, router and digest, resampling and composites (survey rows A2, A12, W13-W15, Q5-Q10, B*, X*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.adapter import table
from pathwise.functions import scalars as fn
from pathwise.operators import episodes as epi
from pathwise.operators import metrics as met
from pathwise.operators import relational as rel
from pathwise.operators import resample as res
from pathwise.operators import sequence as seq
from pathwise.operators import weekly as wk
from pathwise.plans import labels as lab
from pathwise.plans.base import Plans
from pathwise.plans.sequence import PREDICTED, REFERENCE

plans = Plans()
CORE = ["persona_id", "dimension"]


@plans.add("a02_weekly_aggregate", """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, CAST(date_trunc('week', ts) AS DATE) + 6 AS week_end, count(*) AS n_entries, round(avg(value), 6) AS value FROM events GROUP BY ALL""")
def weekly_aggregate(spark, sf):
    weeks = wk.aggregate_weeks(table(spark, sf, "events"), ["value"], ("user_id",), "ts")
    return weeks.select("user_id", "week_start", "week_end", "n_entries", F.round("value", 6).alias("value"))


@plans.add("a12_weekly_digest", """SELECT persona_id, dimension, CAST(date_trunc('week', d) AS DATE) AS week_start, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN score = -1 THEN 1.0 WHEN score IS NOT NULL THEN 0 END), 6) AS pct_neg,
  round(avg(CASE WHEN score = 0 THEN 1.0 WHEN score IS NOT NULL THEN 0 END), 6) AS pct_neutral, round(avg(CASE WHEN score = 1 THEN 1.0 WHEN score IS NOT NULL THEN 0 END), 6) AS pct_pos FROM label GROUP BY ALL""", views=True)
def _(spark, sf):
    return wk.digest(adapter.label(spark, sf)).withColumns({c: F.round(c, 6) for c in ("mean_score", "pct_neg", "pct_neutral", "pct_pos")})


WEEKLY = """
WITH cell2 AS (SELECT persona_id, CAST(date_trunc('week', d) AS DATE) AS week_start, dimension, dim_index, is_core, 1.0 - 2.0 * CAST((event_id * 37 + dim_index * 11) % 101 AS DOUBLE) / 100 AS a0, CAST((event_id * 17 + dim_index * 5) % 61 AS DOUBLE) / 100 AS u0 FROM label),
wk AS (SELECT persona_id, week_start, dimension, dim_index, round(avg(a0), 9) AS alignment, round(avg(u0), 9) AS uncertainty, CASE WHEN is_core THEN 0.5::DOUBLE ELSE 0.0 END AS weight FROM cell2 GROUP BY ALL),
sig AS (SELECT *, round(avg(alignment) OVER (PARTITION BY persona_id, week_start), 9) AS overall_mean, round(avg(uncertainty) OVER (PARTITION BY persona_id, week_start), 9) AS overall_uncertainty FROM wk)
"""


def _weekly(spark, sf):
    e, i = F.col("event_id"), F.col("dim_index")
    rows = adapter.label(spark, sf).select("persona_id", "d", "dimension", "dim_index", "is_core", (F.lit(1.0) - F.lit(2.0) * ((e * 37 + i * 11) % 101).cast("double") / 100).alias("alignment"), (((e * 17 + i * 5) % 61).cast("double") / 100).alias("uncertainty"))
    weeks = wk.aggregate_weeks(rows, ["alignment", "uncertainty"], ("persona_id", "dimension", "dim_index", "is_core"))
    weeks = weeks.withColumns({"alignment": F.round("alignment", 9), "uncertainty": F.round("uncertainty", 9), "weight": F.when(F.col("is_core"), 0.5).otherwise(0.0)})
    p = Window.partitionBy("persona_id", "week_start")
    return weeks.withColumns({"overall_mean": F.round(F.avg("alignment").over(p), 9), "overall_uncertainty": F.round(F.avg("uncertainty").over(p), 9)})


EVOLUTION = WEEKLY + """, recent AS (SELECT *, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY week_start DESC) AS back FROM sig),
evo AS (SELECT persona_id, dimension, count(*) AS n_weeks, arg_min(weight, week_start) AS weight, avg(alignment) AS mean_alignment, stddev_pop(alignment) AS volatility FROM recent WHERE back <= 6 GROUP BY ALL),
ev AS (SELECT *, mean_alignment - least(1.0, greatest(0.0, (weight - 0.15) / 0.85)) AS residual FROM evo),
kind AS (SELECT *, CASE WHEN n_weeks < 3 OR abs(residual) < 0.4 THEN 'stable' WHEN volatility < 0.5 THEN 'evolution' ELSE 'drift' END AS classification FROM ev)
"""


@plans.add("w13_evolution", EVOLUTION + """SELECT persona_id, dimension, n_weeks, round(mean_alignment, 6) AS mean_alignment, round(volatility, 6) AS volatility, round(residual, 6) AS residual, classification,
  CASE WHEN mean_alignment > 1e-6 THEN 'up' WHEN mean_alignment < -1e-6 THEN 'down' ELSE 'flat' END AS direction FROM kind""", views=True)
def _(spark, sf):
    return wk.evolution(_weekly(spark, sf)).select(*CORE, "n_weeks", *(F.round(c, 6).alias(c) for c in ("mean_alignment", "volatility", "residual")), "classification", "direction")


@plans.add("w14_router", EVOLUTION + """, f AS (SELECT s.*, lag(alignment) OVER w - alignment AS fall, lag(overall_mean) OVER w - overall_mean AS sfall, count(*) OVER l AS n, max(alignment) OVER l AS high, max(uncertainty) OVER l AS unsure, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY week_start DESC) AS back
  FROM sig s WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY week_start), l AS (PARTITION BY persona_id, dimension ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
g AS (SELECT f.*, k.classification = 'evolution' AND k.weight >= 0.15 AS e FROM f JOIN kind k ON k.persona_id = f.persona_id AND k.dimension = f.dimension WHERE back = 1),
h AS (SELECT *, weight >= 0.15 AND NOT e AND n = 3 AND high < -0.1 AND unsure < 0.31 AS rut, coalesce(weight >= 0.15 AND NOT e AND sfall > 0.05 AND fall > 0, false) AS crash, row_number() OVER (PARTITION BY persona_id ORDER BY abs(alignment) DESC, weight DESC, dim_index) AS place FROM g),
p AS (SELECT persona_id, max(week_start) AS week_start, max(overall_uncertainty) AS ou, string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE uncertainty >= 0.31) AS v, string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE crash) AS c, string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE rut) AS r,
  string_agg(dimension, ',' ORDER BY dimension) FILTER (WHERE e) AS ev, string_agg(dimension, ',' ORDER BY place) FILTER (WHERE place <= 2) AS st FROM h GROUP BY 1)
SELECT persona_id, week_start, CASE WHEN ou >= 0.31 THEN 'high_uncertainty' WHEN c IS NOT NULL THEN 'crash' WHEN r IS NOT NULL THEN 'rut' WHEN ev IS NOT NULL THEN 'evolution' ELSE 'stable' END AS mode,
  coalesce(CASE WHEN ou >= 0.31 THEN v WHEN c IS NOT NULL THEN c WHEN r IS NOT NULL THEN r WHEN ev IS NOT NULL THEN ev ELSE st END, '') AS dimensions FROM p""", views=True)
def _(spark, sf):
    out = wk.route(_weekly(spark, sf), rut_below=-0.1, crash=0.05, uncertain=0.31)
    return out.withColumn("dimensions", F.array_join("dimensions", ","))


@plans.add("w15_profile_suggestion", EVOLUTION + """, b AS (SELECT *, bool_or(classification = 'evolution') OVER p AS has, CASE WHEN classification = 'evolution' THEN (mean_alignment + 1) / 2 ELSE weight END AS shown FROM kind WINDOW p AS (PARTITION BY persona_id)),
n AS (SELECT *, 0.7 * weight + 0.3 * shown / sum(shown) OVER (PARTITION BY persona_id) AS blended FROM b WHERE has)
SELECT persona_id, dimension, weight, round(blended / sum(blended) OVER (PARTITION BY persona_id), 6) AS suggested FROM n""", views=True)
def _(spark, sf):
    return wk.profile_suggestion(wk.evolution(_weekly(spark, sf))).withColumn("suggested", F.round("suggested", 6))


@plans.add("q10_rank_dimensions", """WITH m AS (SELECT persona_id, CAST(date_trunc('week', d) AS DATE) AS week_start, dimension, dim_index, is_core, avg(score) AS s FROM label GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY persona_id, week_start ORDER BY is_core DESC, s, dim_index) AS rank FROM m WHERE s < 0) SELECT persona_id, week_start, dimension, rank FROM r WHERE rank <= 3""", views=True)
def _(spark, sf):
    means = wk.digest(adapter.label(spark, sf), ("persona_id", "dimension", "dim_index", "is_core"))
    return wk.rank_dimensions(means, "tension", 3).select("persona_id", "week_start", "dimension", "rank")


@plans.add("x28_end_reason", """WITH s AS (SELECT *, lag(t_index) OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS before FROM decision WHERE t_index > 10), b AS (SELECT *, coalesce(before, 10) + 1 <> t_index AS gap FROM s),
r AS (SELECT *, CASE WHEN gap THEN 'gap' WHEN review_status <> 'ok' OR verdict = 'abstain' THEN 'abstain' WHEN verdict = 'not_conflict' THEN 'not_conflict' END AS reason FROM b)
SELECT persona_id, dimension, arg_min(reason, t_index) FILTER (WHERE reason IS NOT NULL) AS end_reason FROM r GROUP BY ALL""", views=True)
def _(spark, sf):
    d = adapter.decision(spark, sf)
    return wk.week_state_reason(d, d.select(*CORE).distinct().withColumn("last_t", F.lit(10)))


@plans.add("q05_threshold_search", REFERENCE + """, e AS (SELECT persona_id, dimension, t_index, p_minus1, uncertainty, lead(t_index) OVER w AS nt, lead(p_minus1) OVER w AS np, lead(uncertainty) OVER w AS nu FROM evidence WINDOW w AS (PARTITION BY persona_id, dimension ORDER BY t_index)),
pairs AS (SELECT persona_id, dimension, nt AS window_end, (p_minus1 + np) / 2 AS p, CASE WHEN uncertainty IS NOT NULL AND nu IS NOT NULL THEN greatest(uncertainty, nu) END AS u FROM e WHERE nt = t_index + 1),
x AS (SELECT p, u, EXISTS (SELECT 1 FROM ref r WHERE r.persona_id = pairs.persona_id AND r.dimension = pairs.dimension AND window_end BETWEEN r.onset_t_index AND r.end_t_index) AS inside FROM pairs),
g AS (SELECT gp.v AS p, gu.v AS u, coalesce(x.p >= gp.v AND x.u <= gu.v, false) AS alert, inside FROM x CROSS JOIN (VALUES (0.5::DOUBLE), (0.6), (0.7)) gp(v) CROSS JOIN (VALUES (0.3::DOUBLE), (0.5)) gu(v)),
c AS (SELECT p, u, count(*) FILTER (WHERE alert AND inside) AS tp, count(*) FILTER (WHERE alert) AS n, count(*) FILTER (WHERE inside) AS m FROM g GROUP BY 1, 2),
s AS (SELECT p, u, tp / nullif(n, 0) AS precision, tp / nullif(m, 0) AS recall FROM c),
f AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1, coalesce(precision >= 0.6, false) AS guarded FROM s)
SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1) FROM f ORDER BY guarded DESC, f1 DESC NULLS LAST, recall DESC NULLS LAST, p, u DESC LIMIT 1""", views=True)
def thresholds(spark, sf):
    """A gate's measures over a grid of thresholds, in one pass over the pairs per grid point; the best guarded one first."""
    reference = seq.reference_episodes(adapter.label(spark, sf).where("is_core"))
    pairs = seq.detection_decisions(adapter.evidence(spark, sf), 0.0, None)
    inside = epi.inside_reference(pairs.select(*CORE, "window_end", "mean_probability", "max_uncertainty"), reference, "window_end")
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(u).alias("u")) for p in (0.5, 0.6, 0.7) for u in (0.3, 0.5)))).alias("g")
    alert = F.coalesce((F.col("mean_probability") >= F.col("g.p")) & (F.col("max_uncertainty") <= F.col("g.u")), F.lit(False))
    m = met.binary_measures(F.col("inside"), alert)
    out = inside.select("*", grid).groupBy("g.p", "g.u").agg(*(m[k].alias(k) for k in ("precision", "recall", "f1")))
    out = out.withColumn("guarded", F.coalesce(F.col("precision") >= 0.6, F.lit(False)))
    return out.orderBy(F.desc("guarded"), F.desc_nulls_last("f1"), F.desc_nulls_last("recall"), F.asc("p"), F.desc("u")).limit(1).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


#: Means to four places by whole numbers (of amounts in hundredths): no order of summation shows in them.
RUNS = "SELECT user_id AS run, event_id % 20 AS epoch, CAST((200 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS q, CAST((20000 * sum(event_id % 100) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS r FROM events GROUP BY ALL"


def _runs(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), (e % 20).alias("epoch")).agg(
        F.expr("cast((200 * sum(cast(round(value * 100) as bigint)) + count(*)) div (2 * count(*)) as double) / 10000").alias("q"),
        F.expr("cast((20000 * sum(event_id % 100) + count(*)) div (2 * count(*)) as double) / 10000").alias("r"))


@plans.add("q06_best_epoch", f"SELECT run, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY q DESC, epoch) AS i FROM ({RUNS})) WHERE i = 1")
def _(spark, sf):
    return rel.top_k(_runs(spark, sf), ["run"], [F.desc_nulls_last(F.nanvl("q", F.lit(float("-inf")))), F.col("epoch")], 1).select("run", "epoch")


@plans.add("q07_recall_window", f"SELECT run, epoch FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY r DESC, q DESC, epoch) AS i FROM (SELECT *, max(q) OVER (PARTITION BY run) AS best FROM ({RUNS})) WHERE q >= best - 10) WHERE i = 1")
def _(spark, sf):
    near = _runs(spark, sf).withColumn("best", F.max("q").over(Window.partitionBy("run"))).where("q >= best - 10")
    return rel.top_k(near, ["run"], [F.desc("r"), F.desc("q"), F.col("epoch")], 1).select("run", "epoch")


@plans.add("q09_candidate_or_baseline", f"WITH b AS (SELECT run, max(CASE WHEN epoch = 0 THEN q END) AS base FROM ({RUNS}) GROUP BY 1), c AS (SELECT t.run, t.epoch, t.q, row_number() OVER (PARTITION BY t.run ORDER BY t.q DESC, t.epoch) AS i FROM ({RUNS}) t JOIN b ON b.run = t.run WHERE t.r >= 50 AND t.q > b.base) SELECT b.run, coalesce(c.epoch, 0) AS epoch FROM b LEFT JOIN c ON c.run = b.run AND i = 1")
def _(spark, sf):
    base = F.max(F.when(F.col("epoch") == 0, F.col("q"))).over(Window.partitionBy("run"))
    rows = _runs(spark, sf).withColumn("base", base).withColumn("ok", (F.col("r") >= 50) & (F.col("q") > F.col("base")))
    best = F.max(F.when(F.col("ok"), F.struct("q", (-F.col("epoch")).alias("e"))))
    return rows.groupBy("run").agg(F.coalesce(-best["e"], F.lit(0)).alias("epoch"))


def _u(*parts: str) -> str:
    """SQL of the draw that the hash of the parts gives."""
    return "(CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + f")), 1, 13) AS BIGINT) / {float(1 << 52)!r})"


def _drawn(clusters: str, cluster: str, top: str, bottom: str, replicates: int, by: str = "") -> str:
    """SQL of a cluster bootstrap's interval over the rows of `clusters`."""
    weight = "CASE " + " ".join(f"WHEN u < {step!r} THEN {k}" for k, step in enumerate(res.poisson_steps())) + " ELSE 9 END"
    first = f"{by}, " if by else ""
    return f"""dr AS (SELECT *, {_u("7", "replicate", cluster)} AS u FROM ({clusters}) CROSS JOIN (SELECT unnest(range(0, {replicates})) AS replicate)),
bv AS (SELECT {first}replicate, sum(w * {top}) / nullif(sum(w * {bottom}), 0) AS value FROM (SELECT *, {weight} AS w FROM dr) GROUP BY {first}replicate)
SELECT {first}round(quantile_cont(value, 0.025), 9) AS low, round(median(value), 9) AS mid, round(quantile_cont(value, 0.975), 9) AS high, count(value) AS n_replicates FROM bv""" + (f" GROUP BY {by}" if by else "")


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("low", "mid", "high")})


@plans.add("b01_cluster_bootstrap", "WITH " + _drawn("SELECT persona_id, dimension, count(*) FILTER (WHERE score = -1) AS hits, count(score) AS n FROM label GROUP BY 1, 2", "persona_id", "hits", "n", 200, "dimension"), views=True)
def bootstrap(spark, sf):
    c = adapter.label(spark, sf).groupBy("persona_id", "dimension").agg(F.count_if(F.col("score") == -1).alias("hits"), F.count("score").alias("n"))
    return _rounded(res.percentile_interval(res.cluster_bootstrap(c, "persona_id", "hits", "n", 200, by=("dimension",)), ("dimension",)))


def _phi(x: str) -> str:
    """SQL of the normal distribution at x, by its series."""
    term = f"list_reduce(range(1, 80), lambda s, k: {{'t': s.t * {x} * {x} / (2 * k + 1), 'a': s.a + s.t * {x} * {x} / (2 * k + 1)}}, {{'t': {x}::DOUBLE, 'a': {x}::DOUBLE}})"
    return f"(0.5 + exp(-{x} * {x} / 2) / sqrt(2 * pi()) * ({term}).a)"


@plans.add("b02_bca_interval", f"""WITH RECURSIVE c AS (SELECT persona_id, count(*) FILTER (WHERE score = -1) AS hits, count(score) AS n FROM ({adapter.over_views("SELECT * FROM label")}) GROUP BY 1), tot AS (SELECT sum(hits) AS t, sum(n) AS b FROM c),
dr AS (SELECT c.*, replicate, {_u("7", "replicate", "persona_id")} AS u FROM c CROSS JOIN (SELECT unnest(range(0, 400)) AS replicate)), bv AS (SELECT replicate, sum(w * hits) / nullif(sum(w * n), 0) AS v FROM (SELECT *, {"CASE " + " ".join(f"WHEN u < {step!r} THEN {k}" for k, step in enumerate(res.poisson_steps())) + " ELSE 9 END"} AS w FROM dr) GROUP BY 1),
j AS (SELECT (t - hits) / (b - n) AS j FROM c, tot WHERE b <> n), jm AS (SELECT avg(j) AS m FROM j), jk AS (SELECT sum((m - j) ** 2) AS squares, sum((m - j) ** 3) AS cubes FROM j, jm),
bl AS (SELECT count(*) FILTER (WHERE v < t / b) / count(v) AS below FROM bv, tot),
z AS (SELECT 0 AS step, -8.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, below FROM bl UNION ALL SELECT step + 1, CASE WHEN {_phi("((lo + hi) / 2)")} < below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_phi("((lo + hi) / 2)")} < below THEN hi ELSE (lo + hi) / 2 END, below FROM z WHERE step < 55),
k AS (SELECT (lo + hi) / 2 AS z0, below, cubes / (6 * squares ** 1.5) AS a, squares FROM z, jk WHERE step = 55),
q AS (SELECT k.*, x.z, x.plain, z0 + (z0 + x.z) / (1 - a * (z0 + x.z)) AS zq FROM k, (VALUES (-1.9599639845400545::DOUBLE, 0.025), (1.9599639845400545::DOUBLE, 0.975)) x(z, plain)),
p AS (SELECT plain, CASE WHEN below > 0 AND below < 1 AND squares > 0 THEN {_phi("zq")} ELSE plain END AS p FROM q), s AS (SELECT list(v ORDER BY v) AS xs FROM bv WHERE v IS NOT NULL),
e AS (SELECT plain, p * (len(xs) - 1) AS x, xs FROM p, s), f AS (SELECT plain, xs[1 + floor(x)::BIGINT] + (x - floor(x)) * (xs[least(2 + floor(x)::BIGINT, len(xs))] - xs[1 + floor(x)::BIGINT]) AS bound FROM e)
SELECT round(t / b, 6) AS estimate, round((SELECT bound FROM f WHERE plain < 0.5), 6) AS low, round((SELECT bound FROM f WHERE plain > 0.5), 6) AS high, 400 AS n_replicates FROM tot""")
def bca(spark, sf):
    c = adapter.label(spark, sf).groupBy("persona_id").agg(F.count_if(F.col("score") == -1).alias("hits"), F.count("score").alias("n"))
    return res.bca_interval(c, "persona_id", "hits", "n", 400).withColumns({x: F.round(x, 6) for x in ("estimate", "low", "high")})


@plans.add("b03_permutation_test", f"""WITH c AS (SELECT persona_id, coalesce(avg(score) FILTER (WHERE dim_index % 2 = 0), 0) AS x, coalesce(avg(score) FILTER (WHERE dim_index % 2 = 1), 0) AS y, count(*) // 100 AS stratum FROM label GROUP BY 1),
dr AS (SELECT *, row_number() OVER (PARTITION BY replicate, stratum ORDER BY persona_id) AS k, row_number() OVER (PARTITION BY replicate, stratum ORDER BY {_u("7", "replicate", "persona_id")}, persona_id) AS j FROM c CROSS JOIN (SELECT unnest(range(0, 100)) AS replicate)),
s AS (SELECT a.replicate, sum(a.x * b.y) AS s FROM dr a JOIN dr b ON b.replicate = a.replicate AND b.stratum = a.stratum AND b.j = a.k GROUP BY 1), o AS (SELECT sum(x * y) AS observed FROM c)
SELECT round(observed, 9) AS observed, (1 + count(*) FILTER (WHERE abs(s) >= abs(observed))) / (count(*) + 1) AS p, count(*) AS n_replicates FROM s, o GROUP BY observed""", views=True)
def permutation(spark, sf):
    c = adapter.label(spark, sf).groupBy("persona_id").agg(
        F.coalesce(F.avg(F.when(F.col("dim_index") % 2 == 0, F.col("score"))), F.lit(0.0)).alias("x"), F.coalesce(F.avg(F.when(F.col("dim_index") % 2 == 1, F.col("score"))), F.lit(0.0)).alias("y"), F.floor(F.count(F.lit(1)) / 100).alias("stratum"))
    return res.permutation_test(c, "persona_id", "stratum", "x", "y", 100).withColumn("observed", F.round("observed", 9))


@plans.add("b04_ratio_bootstrap", "WITH " + _drawn("SELECT persona_id, sum(split) AS top, count(*) AS n FROM (SELECT persona_id, event_id, dimension, CASE WHEN min(score) <> max(score) THEN 1 ELSE 0 END AS split FROM vote GROUP BY 1, 2, 3) GROUP BY 1", "persona_id", "top", "n", 400), views=True)
def ratios(spark, sf):
    cells = adapter.vote(spark, sf).groupBy("persona_id", "event_id", "dimension").agg((F.min("score") != F.max("score")).cast("int").alias("split"))
    c = cells.groupBy("persona_id").agg(F.sum("split").alias("top"), F.count(F.lit(1)).alias("n"))
    return _rounded(res.percentile_interval(res.cluster_bootstrap(c, "persona_id", "top", "n", 400)))


def _episodes(probability: float) -> str:
    return f"({PREDICTED.replace('0.55', str(probability))} SELECT persona_id, dimension, count(*) AS n FROM pred GROUP BY 1, 2)"


@plans.add("b05_paired_bootstrap", "WITH " + _drawn(f"SELECT persona_id || '|' || dimension AS cluster, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, 1 AS one FROM (SELECT DISTINCT persona_id, dimension FROM evidence) k LEFT JOIN {_episodes(0.5)} a USING (persona_id, dimension) LEFT JOIN {_episodes(0.6)} b USING (persona_id, dimension)", "cluster", "delta", "one", 200), views=True)
def paired(spark, sf):
    """Difference of two detectors' hits per trajectory, resampled by trajectory."""
    e = adapter.evidence(spark, sf)
    n = lambda p, name: seq.predicted_episodes(e, p, 0.5).groupBy(*CORE).agg(F.count(F.lit(1)).alias(name))
    both = e.select(*CORE).distinct().join(n(0.5, "a"), CORE, "left").join(n(0.6, "b"), CORE, "left").na.fill(0)
    c = both.select(F.concat_ws("|", F.col("persona_id").cast("string"), "dimension").alias("cluster"), (F.col("a") - F.col("b")).alias("delta"), F.lit(1).alias("one"))
    return _rounded(res.percentile_interval(res.cluster_bootstrap(c, "cluster", "delta", "one", 200)))


@plans.add("b07_gate_grid", """WITH g AS (SELECT * FROM (VALUES (0.4::DOUBLE), (0.6), (0.8)) p(p) CROSS JOIN (VALUES (0.2::DOUBLE), (0.5)) u(u)) SELECT p, u, count(*) FILTER (WHERE p_minus1 >= p AND uncertainty <= u) AS n_pass FROM evidence CROSS JOIN g GROUP BY ALL""", views=True)
def _(spark, sf):
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(u).alias("u")) for p in (0.4, 0.6, 0.8) for u in (0.2, 0.5)))).alias("g")
    ok = F.coalesce((F.col("p_minus1") >= F.col("g.p")) & (F.col("uncertainty") <= F.col("g.u")), F.lit(False))
    return adapter.evidence(spark, sf).select("p_minus1", "uncertainty", grid).groupBy("g.p", "g.u").agg(F.count_if(ok).alias("n_pass"))


@plans.add("b09_dimension_search", lab.PAIRS + """, g AS (SELECT dimension, m, avg(CASE WHEN (CASE WHEN prediction < -m THEN -1 WHEN prediction > m THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0 END) AS acc FROM mc CROSS JOIN (VALUES (0.3::DOUBLE), (0.5), (0.8)) v(m) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY round(acc, 9) DESC, m) AS i FROM g) SELECT dimension, m AS margin, round(acc, 6) AS accuracy FROM r WHERE i = 1""", views=True)
def _(spark, sf):
    rows = lab._pairs(spark, sf).select("dimension", "prediction", "target", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.8))).alias("m"))
    got = F.when(F.col("prediction") < -F.col("m"), -1).when(F.col("prediction") > F.col("m"), 1).otherwise(0)
    acc = rows.groupBy("dimension", "m").agg(F.round(F.avg((got == F.col("target")).cast("double")), 9).alias("acc"))
    return acc.groupBy("dimension").agg(F.max(F.struct("acc", (-F.col("m")).alias("m"))).alias("x")).select("dimension", (-F.col("x.m")).alias("margin"), F.round("x.acc", 6).alias("accuracy"))


@plans.add("x09_source_comparison", """WITH s AS (SELECT 'label' AS source, persona_id, dimension, t_index, score FROM label WHERE is_core UNION ALL SELECT 'vote', v.persona_id, v.dimension, v.t_index, v.score FROM vote v JOIN label l ON l.event_id = v.event_id AND l.dimension = v.dimension WHERE pass = 1 AND is_core),
p AS (SELECT source, persona_id, score = -1 AND lag(score) OVER w = -1 AND lag(t_index) OVER w = t_index - 1 AS hit FROM s WINDOW w AS (PARTITION BY source, persona_id, dimension ORDER BY t_index)), g AS (SELECT source, persona_id, coalesce(bool_or(hit), false) AS hit FROM p GROUP BY ALL)
SELECT source, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1) AS pct FROM g GROUP BY 1""", views=True)
def _(spark, sf):
    base = adapter.label(spark, sf).where("is_core")
    other = adapter.vote(spark, sf).where("pass = 1").where((F.col("dim_index") == F.col("persona_id") % 10) | (F.col("dim_index") == (F.col("persona_id") * 3 + 1) % 10))
    pick = lambda df, name: df.select(F.lit(name).alias("source"), *CORE, "t_index", "score")
    w = Window.partitionBy("source", *CORE).orderBy("t_index")
    s = F.col("score")
    hit = F.coalesce((s == -1) & (F.lag(s).over(w) == -1) & (F.lag("t_index").over(w) == F.col("t_index") - 1), F.lit(False))
    g = pick(base, "label").unionByName(pick(other, "vote")).withColumn("hit", hit).groupBy("source", "persona_id").agg(F.bool_or("hit").alias("hit"))
    return g.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_hit"), F.round(100 * F.avg(F.col("hit").cast("double")), 1).alias("pct"))


@plans.add("x12_candidate_union", "SELECT persona_id, dimension, bool_or(coalesce(score = -1, false)) AS by_label, bool_or(coalesce(score = 1, false)) AS by_support FROM label GROUP BY ALL HAVING count(*) FILTER (WHERE score = -1) > 6 OR count(*) FILTER (WHERE score = 1) > 14", views=True)
def _(spark, sf):
    s, no = F.col("score"), F.lit(False)
    g = adapter.label(spark, sf).groupBy(*CORE).agg(F.bool_or(F.coalesce(s == -1, no)).alias("by_label"), F.bool_or(F.coalesce(s == 1, no)).alias("by_support"), F.count_if(s == -1).alias("a"), F.count_if(s == 1).alias("b"))
    return g.where("a > 6 or b > 14").drop("a", "b")


@plans.add("x37_paired_deltas", f"""WITH p AS (SELECT a.run, a.epoch % 4 AS family, b.q - a.q AS delta FROM ({RUNS}) a JOIN ({RUNS}) b ON b.run = a.run AND b.epoch = a.epoch + 10 WHERE a.epoch < 10) SELECT family, round(min(delta), 6) AS low, round(median(delta), 6) AS mid, round(max(delta), 6) AS high FROM p GROUP BY 1""")
def _(spark, sf):
    pair = _runs(spark, sf).groupBy("run", (F.col("epoch") % 10).alias("e")).agg(F.max(F.when(F.col("epoch") < 10, F.col("q"))).alias("a"), F.max(F.when(F.col("epoch") >= 10, F.col("q"))).alias("b"))
    d = pair.where("a is not null and b is not null").select((F.col("e") % 4).alias("family"), (F.col("b") - F.col("a")).alias("delta"))
    return d.groupBy("family").agg(F.round(F.min("delta"), 6).alias("low"), F.round(F.median("delta"), 6).alias("mid"), F.round(F.max("delta"), 6).alias("high"))


@plans.add("x41_effective_priors", "SELECT dimension, round(avg(p_minus1), 6) AS prior_neg, round(1 - avg(p_minus1), 6) AS prior_rest FROM evidence GROUP BY 1", views=True)
def _(spark, sf):
    return adapter.evidence(spark, sf).groupBy("dimension").agg(F.round(F.avg("p_minus1"), 6).alias("prior_neg"), F.round(1 - F.avg("p_minus1"), 6).alias("prior_rest"))


@plans.add("x43_hard_dimensions", lab.PAIRS + """, a AS (SELECT dimension, avg(CASE WHEN predicted = target THEN 1.0 ELSE 0 END) AS acc FROM mc GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(acc, 9), dimension) AS i FROM a) SELECT dimension, i <= 3 AS by_rank FROM r WHERE i <= 3 OR dimension IN ('security', 'hedonism')""", views=True)
def _(spark, sf):
    a = lab._pairs(spark, sf).groupBy("dimension").agg(F.round(F.avg((F.col("predicted") == F.col("target")).cast("double")), 9).alias("acc"))
    ranked = a.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("acc"), "dimension")))  # ten rows
    return ranked.where((F.col("i") <= 3) | F.col("dimension").isin("security", "hedonism")).select("dimension", (F.col("i") <= 3).alias("by_rank"))


@plans.add("x48_cache_cost", "SELECT l_returnflag, round(sum(l_quantity * 0.25 + l_linenumber * 1.25 + l_tax * 10), 4) AS cost FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * 0.25 + F.col("l_linenumber") * 1.25 + F.col("l_tax") * 10), 4).alias("cost"))


@plans.add("x54_helped_harmed", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN (a.score = l.score) = (b.score = l.score) THEN 'unchanged' WHEN b.score = l.score THEN 'helped' ELSE 'harmed' END AS change FROM vote a JOIN vote b ON a.event_id = b.event_id AND a.dimension = b.dimension AND a.pass = 1 AND b.pass = 2 JOIN label l ON l.event_id = a.event_id AND l.dimension = a.dimension WHERE l.score IS NOT NULL) GROUP BY 1", views=True)
def _(spark, sf):
    v = lambda p: F.max(F.when(F.col("pass") == p, F.col("score")))
    both = adapter.vote(spark, sf).where("pass <= 2").groupBy("event_id", "dimension").agg(v(1).alias("a"), v(2).alias("b"))
    l = adapter.label(spark, sf).where("score is not null").select("event_id", "dimension", "score")  # noqa: E741
    before, after = F.col("a") == F.col("score"), F.col("b") == F.col("score")
    return both.join(l, ["event_id", "dimension"]).groupBy(F.when(before == after, "unchanged").when(after, "helped").otherwise("harmed").alias("change")).agg(F.count(F.lit(1)).alias("n"))


@plans.add("x55_upper_median", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def _(spark, sf):
    w = Window.partitionBy("event_type")
    rows = table(spark, sf, "events").select("event_type", "value", F.row_number().over(w.orderBy("value")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("event_type", F.col("value").alias("upper_median"))


@plans.add("x57_pair_diagnostics", lab.PAIRS + ", p AS (SELECT persona_id, t_index // 4 AS g, dimension, max(CASE WHEN target = 1 THEN prediction END) AS hi, max(CASE WHEN target = -1 THEN prediction END) AS lo FROM mc GROUP BY ALL) SELECT dimension, count(*) AS n, round(avg(CASE WHEN hi > lo THEN 1.0 ELSE 0 END), 6) AS directional, round(avg(hi - lo), 6) AS margin FROM p WHERE hi IS NOT NULL AND lo IS NOT NULL GROUP BY 1", views=True)
def _(spark, sf):
    side = lambda t: F.max(F.when(F.col("target") == t, F.col("prediction")))
    p = lab._pairs(spark, sf).groupBy("persona_id", F.floor(F.col("t_index") / 4).alias("g"), "dimension").agg(side(1).alias("hi"), side(-1).alias("lo")).where("hi is not null and lo is not null")
    return p.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("hi") > F.col("lo")).cast("double")), 6).alias("directional"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("margin"))


@plans.add("x60_weighted_choice", f"SELECT CASE WHEN u < 0.5 THEN 'none' WHEN u < 0.8 THEN 'soft' ELSE 'deep' END AS choice, count(*) AS n FROM (SELECT {_u('7', 'event_id')} AS u FROM events) GROUP BY 1")
def choices(spark, sf):
    return res.weighted_choice(table(spark, sf, "events").select("event_id"), {"none": 0.5, "soft": 0.3, "deep": 0.2}, F.lit(7), F.col("event_id")).groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


@plans.add("w37_difficulty_rank", lab.PAIRS + ", e AS (SELECT dimension, round(avg(abs(prediction - target)), 9) AS err FROM mc GROUP BY 1) SELECT dimension, row_number() OVER (ORDER BY err DESC NULLS LAST, dimension) AS place FROM e", views=True)
def _(spark, sf):
    e = lab._pairs(spark, sf).groupBy("dimension").agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("target"))), 9).alias("err"))
    return e.select("dimension", F.row_number().over(Window.orderBy(F.desc_nulls_last("err"), "dimension")).alias("place"))  # ten rows
