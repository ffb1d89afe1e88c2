"""Composites of votes, metrics and trajectories (survey rows X17-X59)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.adapter import table
from pathwise.functions import scalars as fn
from pathwise.operators import change_points as cps
from pathwise.operators import metrics as met
from pathwise.operators import relational as rel
from pathwise.plans import labels as lab
from pathwise.plans.base import Plans

plans = Plans()
CORE = ["persona_id", "dimension"]
CELL = ["event_id", "dimension"]


@plans.add("x19_model_disagreement", """WITH m AS (SELECT persona_id, dimension, pass, string_agg(CAST(score AS VARCHAR), ',' ORDER BY score, t_index) AS tokens FROM vote WHERE pass <= 2 GROUP BY ALL)
SELECT persona_id, dimension FROM m GROUP BY ALL HAVING count(DISTINCT tokens) > 1""", views=True)
def _(spark, sf):
    return _models_differ(adapter.vote(spark, sf))


def _models_differ(votes: DataFrame) -> DataFrame:
    """Two models differ in their sorted verdicts exactly where they differ in how many there are of each. Only the votes of the
    two are made."""
    more = lambda s: F.sum(F.when(F.col("score") == s, 3 - 2 * F.col("pass")).otherwise(0))
    differ = reduce(lambda a, b: a | b, (more(s) != 0 for s in (-1, 0, 1)))
    return votes.where("pass <= 2").groupBy(*CORE).agg(differ.alias("differ")).where("differ").drop("differ")


@plans.add("x21_aggregate_parity", "WITH s AS (SELECT dimension, count(*) AS stored FROM vote WHERE pass = 1 AND (dim_index <> 3 OR score <> 0) GROUP BY 1) SELECT dimension, count(*) AS n, count(*) = (SELECT stored FROM s WHERE s.dimension = label.dimension) AS equal FROM label GROUP BY 1", views=True)
def _(spark, sf):
    """Counts of the labels against those that a pass's aggregate stores, which lacks one dimension's neutral votes."""
    votes = adapter.vote(spark, sf).where("pass = 1 and (dim_index <> 3 or score <> 0)")
    stored = votes.groupBy("dimension", "persona_id").agg(F.count(F.lit(1)).alias("n")).groupBy("dimension").agg(F.sum("n").alias("stored"))
    now = adapter.label(spark, sf).groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
    return now.join(stored, "dimension").select("dimension", "n", (F.col("n") == F.col("stored")).alias("equal"))


@plans.add("x23_receipt_completeness", """SELECT persona_id, t_index, dimension, count(*) AS n_runs, count(DISTINCT pass) = 3 AND count(*) = 3 AS complete FROM vote WHERE pass <= 3 AND NOT (pass = 3 AND event_id % 20 = 0) GROUP BY ALL""", views=True)
def _(spark, sf):
    rows = adapter.vote(spark, sf).where("pass <= 3 and not (pass = 3 and event_id % 20 = 0)")
    return rows.groupBy("persona_id", "t_index", "dimension").agg(F.count(F.lit(1)).alias("n_runs"), ((F.count_distinct("pass") == 3) & (F.count(F.lit(1)) == 3)).alias("complete"))


@plans.add("x32_unique_timelines", "SELECT persona_id, t_index, count(DISTINCT d) = 1 AS consistent, count(*) AS n_cases FROM label GROUP BY ALL", views=True)
def _(spark, sf):
    return adapter.label(spark, sf).groupBy("persona_id", "t_index").agg((F.min("d") == F.max("d")).alias("consistent"), F.count(F.lit(1)).alias("n_cases"))


@plans.add("x33_target_swap", lab.PAIRS + """, s AS (SELECT mc.dimension, unnest(['label', 'vote']) AS lens, unnest([target, v.score]) AS t, predicted AS p FROM mc JOIN vote v ON v.event_id = mc.event_id AND v.dimension = mc.dimension AND v.pass = 1)
SELECT lens, count(*) FILTER (WHERE t = -1 AND p = -1) AS tp, count(*) FILTER (WHERE t <> -1 AND p = -1) AS fp, count(*) FILTER (WHERE t = -1 AND p <> -1) AS fn FROM s GROUP BY 1""", views=True)
def _(spark, sf):
    v = adapter.vote(spark, sf).where("pass = 1").select(*CELL, "score")
    both = F.array(F.struct(F.lit("label").alias("lens"), F.col("target").alias("t")), F.struct(F.lit("vote").alias("lens"), F.col("score").alias("t")))
    m = met.binary_measures(F.col("t") == -1, F.col("predicted") == -1)
    return lab._pairs(spark, sf).join(v, CELL).select("predicted", F.inline(both)).groupBy("lens").agg(*(m[k].alias(k) for k in ("tp", "fp", "fn")))


#: Means of amounts in hundredths, to four places, by whole numbers: no order of summation shows in them.
RUNS = "SELECT user_id AS run, event_id % 20 AS epoch, CAST((200 * sum(CAST(round(value * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS q FROM events GROUP BY ALL"


def _runs(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 20).alias("epoch")).agg(F.expr("cast((200 * sum(cast(round(value * 100) as bigint)) + count(*)) div (2 * count(*)) as double) / 10000").alias("q"))


def _against_first(spark, sf):
    """Each run's epochs against its own epoch 0."""
    base = F.max(F.when(F.col("epoch") == 0, F.col("q"))).over(Window.partitionBy("run"))
    return _runs(spark, sf).withColumn("base", base).where("epoch > 0 and base is not null").withColumn("delta", F.col("q") - F.col("base"))


DELTAS = f"WITH r AS ({RUNS}), d AS (SELECT a.run, a.epoch, a.q, b.q AS base, a.q - b.q AS delta FROM r a JOIN r b ON b.run = a.run AND b.epoch = 0 WHERE a.epoch > 0)"


@plans.add("x38_family_deltas", DELTAS + " SELECT epoch % 4 AS family, round(median(delta), 6) AS mid, count(*) AS n FROM d GROUP BY 1")
def _(spark, sf):
    return _against_first(spark, sf).groupBy((F.col("epoch") % 4).alias("family")).agg(F.round(F.median("delta"), 6).alias("mid"), F.count(F.lit(1)).alias("n"))


@plans.add("x40_ineligible_reasons", DELTAS + " SELECT run, epoch, concat_ws(',', CASE WHEN delta < -5 THEN 'worse' END, CASE WHEN q < 30 THEN 'low' END) AS reasons FROM d")
def _(spark, sf):
    reasons = F.concat_ws(",", F.when(F.col("delta") < -5, "worse"), F.when(F.col("q") < 30, "low"))
    return _against_first(spark, sf).select("run", "epoch", reasons.alias("reasons"))


@plans.add("x42_run_deltas", DELTAS + " SELECT run, round(min(delta), 4) AS low, round(max(delta), 4) AS high FROM d GROUP BY 1")
def _(spark, sf):
    return _against_first(spark, sf).groupBy("run").agg(F.round(F.min("delta"), 4).alias("low"), F.round(F.max("delta"), 4).alias("high"))


@plans.add("x44_cluster_sizes", "SELECT n, count(*) AS n_clusters FROM (SELECT persona_id, count(*) AS n FROM entry GROUP BY 1) GROUP BY 1", views=True)
def _(spark, sf):
    return adapter.entry(spark, sf).groupBy("persona_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("n_clusters"))


@plans.add("x46_matched_manifest", "SELECT count(*) AS n_rows, count(d.event_id) AS n_matched FROM label l LEFT JOIN decision d ON d.event_id = l.event_id AND d.dimension = l.dimension WHERE l.is_core", views=True)
def _(spark, sf):
    d = adapter.decision(spark, sf).select(*CELL, F.lit(1).alias("hit"))
    return rel.join_checked(adapter.label(spark, sf).where("is_core"), d, CELL, "m:1").agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_matched"))


@plans.add("x47_target_variant", """WITH v AS (SELECT event_id, dimension, max(CASE WHEN pass = 1 THEN score END) AS a, max(CASE WHEN pass = 2 THEN score END) AS b, max(CASE WHEN pass = 3 THEN score END) AS c FROM vote GROUP BY ALL)
SELECT CASE WHEN a = c THEN 'matches_full_context' WHEN a = b THEN 'changes_with_bio_or_history' WHEN b = c THEN 'changes_between_active_state_and_legacy_profile_prompt' ELSE 'unresolved_context_sensitivity' END AS bucket, count(*) AS n FROM v GROUP BY 1""", views=True)
def _(spark, sf):
    v = lambda p: F.max(F.when(F.col("pass") == p, F.col("score")))
    rows = adapter.vote(spark, sf).where("pass <= 3").groupBy(*CELL).agg(v(1).alias("a"), v(2).alias("b"), v(3).alias("c"))
    return rows.groupBy(fn.reachability_bucket("a", "b", "c").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@plans.add("x50_importance_weights", """WITH c AS (SELECT dimension, CAST(count(*) FILTER (WHERE score = -1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE score = 0) AS DOUBLE) AS z, CAST(count(*) FILTER (WHERE score = 1) AS DOUBLE) AS b FROM label GROUP BY 1),
w AS (SELECT dimension, 1 / sqrt(greatest(1, least(a, z + b))) AS x, 1 / sqrt(greatest(1, least(a + z, b))) AS y FROM c) SELECT dimension, round(2 * x / (x + y), 6) AS w_first, round(2 * y / (x + y), 6) AS w_second FROM w""", views=True)
def _(spark, sf):
    n = lambda v: F.count_if(F.col("score") == v).cast("double")
    c = adapter.label(spark, sf).groupBy("dimension").agg(n(-1).alias("a"), n(0).alias("z"), n(1).alias("b"))
    inverse = lambda lo, hi: 1 / F.sqrt(F.greatest(F.lit(1.0), F.least(lo, hi)))
    w = c.select("dimension", inverse(F.col("a"), F.col("z") + F.col("b")).alias("x"), inverse(F.col("a") + F.col("z"), F.col("b")).alias("y"))
    return w.select("dimension", F.round(2 * F.col("x") / (F.col("x") + F.col("y")), 6).alias("w_first"), F.round(2 * F.col("y") / (F.col("x") + F.col("y")), 6).alias("w_second"))


@plans.add("x56_study_verdict", DELTAS + ", m AS (SELECT epoch, median(delta) AS mid FROM d GROUP BY 1) SELECT epoch, CASE WHEN mid > 2 THEN 'adopt' WHEN mid < -2 THEN 'reject' ELSE 'inconclusive' END AS verdict FROM m")
def _(spark, sf):
    m = _against_first(spark, sf).groupBy("epoch").agg(F.median("delta").alias("mid"))
    return m.select("epoch", F.when(F.col("mid") > 2, "adopt").when(F.col("mid") < -2, "reject").otherwise("inconclusive").alias("verdict"))


@plans.add("x58_nested_usage", "SELECT l_returnflag, round(sum(l_quantity) * 0.5 + sum(l_linenumber) * 2, 4) AS price_a, round(sum(l_quantity) * 0.25 + sum(l_linenumber) * 4, 4) AS price_b FROM lineitem GROUP BY 1")
def _(spark, sf):
    usage = table(spark, sf, "lineitem").select("l_returnflag", F.struct(F.col("l_quantity").alias("input"), F.struct(F.col("l_linenumber").alias("output")).alias("detail")).alias("usage"))
    total = lambda path: F.sum(F.coalesce(F.col(path), F.lit(0)))
    i, o = total("usage.input"), total("usage.detail.output")
    return usage.groupBy("l_returnflag").agg(F.round(i * 0.5 + o * 2, 4).alias("price_a"), F.round(i * 0.25 + o * 4, 4).alias("price_b"))


@plans.add("x59_latency_by_repeat", "SELECT event_type, CAST(event_id % 3 AS VARCHAR) AS repeat, round(median(value), 6) AS mid FROM events GROUP BY ALL UNION ALL SELECT event_type, 'all', round(median(value), 6) FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("event_id") % 3).cast("string").alias("repeat"), F.coalesce("value", F.raise_error(F.lit("missing latency")).cast("double")).alias("v"))
    return DataFrame.unionByName(e.groupBy("event_type", "repeat").agg(F.round(F.median("v"), 6).alias("mid")), e.groupBy("event_type").agg(F.round(F.median("v"), 6).alias("mid")).withColumn("repeat", F.lit("all")))


@plans.add("w24_change_points", adapter.VIEWS.replace("WITH entry", "WITH RECURSIVE entry", 1) + """, o AS (SELECT persona_id, dimension, t_index, CASE score WHEN -1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS k, row_number() OVER (PARTITION BY persona_id, dimension ORDER BY t_index) AS i FROM label WHERE is_core AND score IS NOT NULL),
r AS (SELECT DISTINCT persona_id, dimension, CAST(-1 AS BIGINT) AS t_index, CAST(0 AS BIGINT) AS i, [1.0::DOUBLE] AS a, [1.0::DOUBLE] AS b, [1.0::DOUBLE] AS c, [1.0::DOUBLE] AS w, 1.0::DOUBLE AS p FROM o
  UNION ALL SELECT persona_id, dimension, t_index, i, list_transform(list_append(a, 1.0), lambda x: x + (k = 0)::INTEGER), list_transform(list_append(b, 1.0), lambda x: x + (k = 1)::INTEGER), list_transform(list_append(c, 1.0), lambda x: x + (k = 2)::INTEGER), list_transform(j, lambda x: x / list_sum(j)), (0.1 / 3) / list_sum(j)
  FROM (SELECT r.persona_id, r.dimension, o.t_index, o.i, o.k, a, b, c, list_append(list_transform(range(1, len(w) + 1), lambda n: w[n] * 0.9 * (CASE o.k WHEN 0 THEN a[n] WHEN 1 THEN b[n] ELSE c[n] END) / (a[n] + b[n] + c[n])), 0.1::DOUBLE / 3) AS j FROM r JOIN o ON o.persona_id = r.persona_id AND o.dimension = r.dimension AND o.i = r.i + 1))
SELECT persona_id, dimension, t_index, round(p, 6) AS p_change FROM r WHERE i > 0""")
def regimes(spark, sf):
    return cps.change_points(adapter.label(spark, sf).where("is_core")).withColumn("p_change", F.round("p_change", 6))
