"""Votes and metrics queries (survey rows V*, M*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathwise import adapter
from pathwise.functions import scalars as fn
from pathwise.operators import metrics as met
from pathwise.operators import votes as vot
from pathwise.plans.base import Plans

plans = Plans()
CELL = ["event_id", "dimension"]

TALLY = """
WITH t AS (SELECT event_id, dimension, count(*) FILTER (WHERE score = -1) AS a, count(*) FILTER (WHERE score = 0) AS z, count(*) FILTER (WHERE score = 1) AS b FROM vote GROUP BY ALL),
con AS (SELECT event_id, dimension, CASE WHEN z >= 3 THEN 0 WHEN b > a THEN 1 WHEN a > b THEN -1 ELSE 0 END AS label,
  CASE WHEN z >= 3 THEN CASE z WHEN 5 THEN 'unanimous' WHEN 4 THEN 'strong' ELSE 'bare_majority' END WHEN a = b THEN 'no_majority' WHEN greatest(a, b) = 5 THEN 'unanimous' WHEN greatest(a, b) = 4 THEN 'strong' ELSE 'bare_majority' END AS tier FROM t)
"""


@plans.add("v01_resolve_votes", TALLY + "SELECT event_id, dimension, label, tier FROM con", views=True)
def _(spark, sf):
    return vot.resolve(adapter.vote(spark, sf), CELL).select(*CELL, "label", "tier")


@plans.add("v02_label_counts", TALLY + "SELECT dimension, label, count(*) AS n FROM con GROUP BY ALL", views=True)
def _(spark, sf):
    return vot.resolve(adapter.vote(spark, sf), CELL).groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("n"))


@plans.add("v03_rationale_source", TALLY + """, m AS (SELECT v.event_id, v.pass, count(*) FILTER (WHERE v.score = con.label) AS n FROM vote v JOIN con ON con.event_id = v.event_id AND con.dimension = v.dimension GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, pass) AS i FROM m) SELECT event_id, pass AS source_pass, n AS matches FROM r WHERE i = 1""", views=True)
def _(spark, sf):
    return vot.rationale_pass(adapter.vote(spark, sf), ["persona_id", "event_id"]).drop("persona_id")  # votes are dealt by persona


@plans.add("v04_majority_tiebreak", """WITH t AS (SELECT event_id, dimension, max(CASE WHEN pass = 1 THEN score END) AS v1, max(CASE WHEN pass = 2 THEN score END) AS v2, max(CASE WHEN pass = 3 THEN score END) AS v3, max(CASE WHEN pass = 4 THEN score END) AS v4 FROM vote GROUP BY ALL)
SELECT event_id, dimension, v1 <> v2 AND v1 <> v3 AND v2 <> v3 AS tied, CASE WHEN v1 = v2 OR v1 = v3 THEN v1 WHEN v2 = v3 THEN v2 ELSE v4 END AS label FROM t""", views=True)
def _(spark, sf):
    return vot.majority_with_tiebreak(adapter.vote(spark, sf), CELL)


@plans.add("v05_tie_cases", "SELECT event_id, dimension FROM vote WHERE pass <= 3 GROUP BY ALL HAVING count(*) = 3 AND count(DISTINCT score) = 3", views=True)
def _(spark, sf):
    return vot.majority_with_tiebreak(adapter.vote(spark, sf), CELL).where("tied").select(*CELL)


@plans.add("v06_soft_target", """WITH t AS (SELECT event_id, dimension, count(*) FILTER (WHERE score = -1) / count(*) AS a, count(*) FILTER (WHERE score = 0) / count(*) AS z, count(*) FILTER (WHERE score = 1) / count(*) AS b
  FROM vote WHERE dimension <> 'security' OR pass <= 3 GROUP BY ALL) SELECT event_id, dimension, round(a, 6) AS p_neg, round(z, 6) AS p_zero, round(b, 6) AS p_pos FROM t""", views=True)
def _(spark, sf):
    votes = adapter.vote(spark, sf).where("dimension <> 'security' or pass <= 3")
    p = F.col("p")
    return vot.vote_distribution(votes, CELL).select(*CELL, F.round(p[0], 6).alias("p_neg"), F.round(p[1], 6).alias("p_zero"), F.round(p[2], 6).alias("p_pos"))


def _answers(spark, sf, number: int) -> DataFrame:
    answer = F.when(F.col("score") == 0, "no").when(F.col("score") == -1, "yes").otherwise("unclear")
    return adapter.vote(spark, sf).where(F.col("pass") == number).select("persona_id", "event_id", "dimension", answer.alias("answer"))


ANSWERS = """WITH x AS (SELECT persona_id, event_id, dimension, pass, CASE score WHEN 0 THEN 'no' WHEN -1 THEN 'yes' ELSE 'unclear' END AS answer FROM vote),
z AS MATERIALIZED (SELECT persona_id, event_id, dimension, max(answer) FILTER (WHERE pass = 1) AS a, max(answer) FILTER (WHERE pass = 2) AS b, max(answer) FILTER (WHERE pass = 3) AS c FROM x GROUP BY ALL),
y AS (SELECT *, a = b AND a IN ('yes', 'no') AS agreed FROM z)
"""


@plans.add("v07_case_delta", ANSWERS + "SELECT event_id, dimension, bool_and(agreed) OVER (PARTITION BY persona_id, dimension) AS agreed, CASE WHEN bool_and(agreed) OVER (PARTITION BY persona_id, dimension) THEN a END AS answer FROM y", views=True)
def _(spark, sf):
    keys = ["persona_id", "event_id", "dimension"]
    return vot.reconcile(_answers(spark, sf, 1), _answers(spark, sf, 2), keys, case=["persona_id", "dimension"]).select("event_id", "dimension", "agreed", "answer")


@plans.add("v08_reconcile", ANSWERS + "SELECT event_id, dimension, agreed, CASE WHEN agreed THEN a END AS answer FROM y ORDER BY ALL", views=True)
def _(spark, sf):
    return vot.reconcile(_answers(spark, sf, 1), _answers(spark, sf, 2), CELL).select(*CELL, "agreed", "answer")


@plans.add("v09_adjudicate", ANSWERS + "SELECT event_id, dimension, CASE WHEN agreed THEN a ELSE c END AS answer FROM y ORDER BY ALL", views=True)
def _(spark, sf):
    open_ = vot.reconcile(_answers(spark, sf, 1), _answers(spark, sf, 2), CELL)
    rulings = _answers(spark, sf, 3).join(open_.where("answer is null").select(*CELL), CELL, "left_semi")
    return vot.adjudicate(open_, rulings, CELL).select(*CELL, "answer")


@plans.add("v12_id_problems", """WITH got AS (SELECT event_id FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT event_id FROM events WHERE event_id % 15 = 1 UNION ALL SELECT -event_id FROM events WHERE event_id % 50 = 3),
g AS (SELECT event_id, count(*) AS n FROM got GROUP BY 1)
SELECT coalesce(e.event_id, g.event_id) AS event_id, CASE WHEN e.event_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS problem FROM events e FULL JOIN g ON g.event_id = e.event_id WHERE e.event_id IS NULL OR n IS NULL OR n > 1""")
def _(spark, sf):
    ids = adapter.table(spark, sf, "events").select("event_id")
    got = reduce(DataFrame.unionByName, [ids.where("event_id % 10 <> 0"), ids.where("event_id % 15 = 1"), ids.where("event_id % 50 = 3").select((-F.col("event_id")).alias("event_id"))])
    return vot.id_problems(ids, got, "event_id")


@plans.add("v14_blind_lanes", "SELECT event_id, left(sha256('lane|' || event_id), 12) AS blind_id, left(sha256('lane|' || event_id), 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM events")
def _(spark, sf):
    d = F.sha2(F.concat_ws("|", F.lit("lane"), F.col("event_id").cast("string")), 256)
    return adapter.table(spark, sf, "events").select("event_id", F.substring(d, 1, 12).alias("blind_id"), (F.conv(F.substring(d, 1, 1), 16, 10).cast("int") % 2 == 1).alias("swapped"))


@plans.add("v15_fail_closed", """WITH u AS (SELECT persona_id, t_index, dimension, is_core, NULL AS verdict, NULL AS review_status FROM label WHERE is_core UNION ALL SELECT persona_id, t_index, dimension, NULL, verdict, review_status FROM decision),
g AS MATERIALIZED (SELECT persona_id, t_index, dimension, bool_or(is_core) AS known, max(verdict) FILTER (WHERE review_status = 'ok') AS verdict FROM u GROUP BY ALL)
SELECT persona_id, t_index, dimension, coalesce(verdict, 'abstain') AS verdict FROM g WHERE known ORDER BY ALL""", views=True)
def _(spark, sf):
    keys = ["persona_id", "t_index", "dimension"]
    return vot.fail_closed(adapter.label(spark, sf).where("is_core").select(*keys), adapter.decision(spark, sf), keys)


# Metrics: a prediction per label, from the evidence formulas.

PAIRS = """
WITH m AS (SELECT event_id, persona_id, t_index, dimension, dim_index, score AS target, 1.0 - 2.0 * CAST((event_id * 37 + dim_index * 11) % 101 AS DOUBLE) / 100 AS prediction, CAST((event_id * 17 + dim_index * 5) % 61 AS DOUBLE) / 100 AS uncertainty FROM label WHERE score IS NOT NULL),
mc AS (SELECT *, CASE WHEN prediction < -0.5 THEN -1 WHEN prediction > 0.5 THEN 1 ELSE 0 END AS predicted FROM m)
"""


def _pairs(spark, sf):
    e, i = F.col("event_id"), F.col("dim_index")
    df = adapter.label(spark, sf).where("score is not null").select(
        "event_id", "persona_id", "t_index", "dimension", "dim_index", F.col("score").alias("target"), (F.lit(1.0) - F.lit(2.0) * ((e * 37 + i * 11) % 101).cast("double") / 100).alias("prediction"), (((e * 17 + i * 5) % 61).cast("double") / 100).alias("uncertainty"))
    return df.withColumn("predicted", fn.discretized("prediction"))


def _rounded(**columns):
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


@plans.add("m01_errors", PAIRS + "SELECT dimension, round(avg((prediction - target) * (prediction - target)), 6) AS mse, round(avg(abs(prediction - target)), 6) AS mae FROM mc GROUP BY 1", views=True)
def _(spark, sf):
    e = met.error_measures("prediction", "target")
    return _pairs(spark, sf).groupBy("dimension").agg(*_rounded(mse=e["mse"], mae=e["mae"]))


@plans.add("m02_accuracy", PAIRS + "SELECT dimension, round(avg(CASE WHEN predicted = target THEN 1.0 ELSE 0 END), 6) AS accuracy FROM mc GROUP BY 1", views=True)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("dimension").agg(*_rounded(accuracy=F.avg((F.col("predicted") == F.col("target")).cast("double"))))


QWK = "round(1 - n * sum_d2 / nullif(n * sx2 + n * sy2 - 2 * sx * sy, 0), 6)"


@plans.add("m03_quadratic_kappa", PAIRS + f""", s AS (SELECT dimension, CAST(count(*) AS DOUBLE) AS n, CAST(sum((predicted - target) * (predicted - target)) AS DOUBLE) AS sum_d2, CAST(sum(predicted) AS DOUBLE) AS sx, CAST(sum(target) AS DOUBLE) AS sy, CAST(sum(predicted * predicted) AS DOUBLE) AS sx2, CAST(sum(target * target) AS DOUBLE) AS sy2 FROM mc GROUP BY 1)
SELECT dimension, CASE WHEN n * sx2 > sx * sx AND n * sy2 > sy * sy THEN {QWK} END AS qwk FROM s""", views=True)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("dimension").agg(*_rounded(qwk=met.quadratic_kappa("predicted", "target")))


@plans.add("m04_cohen_kappa", """WITH p AS (SELECT a.dimension, a.score AS x, b.score AS y FROM vote a JOIN vote b ON a.event_id = b.event_id AND a.dimension = b.dimension AND a.pass = 1 AND b.pass = 2),
s AS (SELECT dimension, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE x = y) AS hit, CAST(count(*) FILTER (WHERE x = -1) AS DOUBLE) * count(*) FILTER (WHERE y = -1) + CAST(count(*) FILTER (WHERE x = 0) AS DOUBLE) * count(*) FILTER (WHERE y = 0) + CAST(count(*) FILTER (WHERE x = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 1) AS ch FROM p GROUP BY GROUPING SETS ((dimension), ()))
SELECT coalesce(dimension, 'all') AS dimension, round((hit / n - ch / (n * n)) / nullif(1 - ch / (n * n), 0), 3) AS kappa FROM s""", views=True)
def _(spark, sf):
    v = lambda p: F.max(F.when(F.col("pass") == p, F.col("score")))
    pairs = adapter.vote(spark, sf).where("pass <= 2").groupBy(*CELL).agg(v(1).alias("x"), v(2).alias("y"))
    return pairs.rollup("dimension").agg(F.round(met.cohen_kappa("x", "y"), 3).alias("kappa")).select(F.coalesce("dimension", F.lit("all")).alias("dimension"), "kappa")


@plans.add("m05_fleiss_kappa", """WITH i AS (SELECT dimension, event_id, CAST(count(*) FILTER (WHERE score = -1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE score = 0) AS DOUBLE) AS z, CAST(count(*) FILTER (WHERE score = 1) AS DOUBLE) AS b FROM vote GROUP BY ALL),
s AS (SELECT dimension, count(*) AS n_items, avg((a * (a - 1) + z * (z - 1) + b * (b - 1)) / 20) AS p, sum(a) / sum(a + z + b) AS pa, sum(z) / sum(a + z + b) AS pz, sum(b) / sum(a + z + b) AS pb FROM i GROUP BY 1)
SELECT dimension, n_items, round((p - (pa * pa + pz * pz + pb * pb)) / nullif(1 - (pa * pa + pz * pz + pb * pb), 0), 6) AS kappa FROM s""", views=True)
def _(spark, sf):
    return met.fleiss_kappa(adapter.vote(spark, sf), ["dimension"], "event_id").withColumn("kappa", F.round("kappa", 6))


@plans.add("m06_agreement_table", """SELECT a.dimension, count(*) AS n, count(*) FILTER (WHERE a.score = b.score) AS n_match, round(avg(CASE WHEN a.score = b.score THEN 1.0 ELSE 0 END), 6) AS share FROM vote a JOIN vote b ON a.event_id = b.event_id AND a.dimension = b.dimension AND a.pass = 1 AND b.pass = 2 GROUP BY 1""", views=True)
def _(spark, sf):
    v = lambda p: F.max(F.when(F.col("pass") == p, F.col("score")))
    pairs = adapter.vote(spark, sf).where("pass <= 2").groupBy(*CELL).agg(v(1).alias("x"), v(2).alias("y"))
    same = F.col("x") == F.col("y")
    return pairs.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_match"), F.round(F.avg(same.cast("double")), 6).alias("share"))


RANKS = """r AS (SELECT dimension, CAST(rank() OVER (PARTITION BY dimension ORDER BY {a}) AS DOUBLE) + (count(*) OVER (PARTITION BY dimension, {a}) - 1) / 2.0 AS x, CAST(rank() OVER (PARTITION BY dimension ORDER BY {b}) AS DOUBLE) + (count(*) OVER (PARTITION BY dimension, {b}) - 1) / 2.0 AS y FROM {t})"""


@plans.add("m07_spearman", PAIRS + ", " + RANKS.format(a="prediction", b="target", t="mc") + " SELECT dimension, round(corr(x, y), 6) AS rho FROM r GROUP BY 1", views=True)
def _(spark, sf):
    return met.spearman(_pairs(spark, sf), ["dimension"], "prediction", "target").withColumn("rho", F.round("rho", 6))


@plans.add("m08_recalls", PAIRS + "SELECT dimension, " + ", ".join(f"round(count(*) FILTER (WHERE target = {k} AND predicted = {k}) / nullif(count(*) FILTER (WHERE target = {k}), 0), 6) AS {n}" for k, n in ((-1, "neg"), (0, "zero"), (1, "pos"))) + " FROM mc GROUP BY 1", views=True)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("dimension").agg(*_rounded(**{n: met.recall_of("target", "predicted", k) for k, n in ((-1, "neg"), (0, "zero"), (1, "pos"))}))


BINARY = """count(*) FILTER (WHERE {t} AND {p}) AS tp, count(*) FILTER (WHERE NOT ({t}) AND {p}) AS fp, count(*) FILTER (WHERE {t} AND NOT coalesce({p}, false)) AS fn, count(*) FILTER (WHERE ({p}) IS NULL) AS n_abstained,
  round(count(*) FILTER (WHERE {t} AND {p}) / nullif(count(*) FILTER (WHERE {p}), 0), 6) AS precision, round(count(*) FILTER (WHERE {t} AND {p}) / nullif(count(*) FILTER (WHERE {t}), 0), 6) AS recall,
  round(2 * count(*) FILTER (WHERE {t} AND {p}) / nullif(2 * count(*) FILTER (WHERE {t} AND {p}) + count(*) FILTER (WHERE NOT ({t}) AND {p}) + count(*) FILTER (WHERE {t} AND NOT coalesce({p}, false)), 0), 6) AS f1"""


def _binary(target, predicted):
    return [F.round(c, 6).alias(k) if k in ("precision", "recall", "f1") else c.alias(k) for k, c in met.binary_measures(target, predicted).items()]


@plans.add("m09_activation", PAIRS + "SELECT dimension, " + BINARY.format(t="target <> 0", p="abs(prediction) >= 0.5") + " FROM mc GROUP BY 1", views=True)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("dimension").agg(*_binary(F.col("target") != 0, F.abs("prediction") >= 0.5))


@plans.add("m10_sign_accuracy", PAIRS + "SELECT dimension, round(avg(CASE WHEN sign(prediction) = target THEN 1.0 ELSE 0 END), 6) AS accuracy FROM mc WHERE target <> 0 GROUP BY 1", views=True)
def _(spark, sf):
    return _pairs(spark, sf).where("target <> 0").groupBy("dimension").agg(*_rounded(accuracy=F.avg((F.signum("prediction") == F.col("target")).cast("double"))))


@plans.add("m11_hedging", PAIRS + "SELECT dimension, round(avg(CASE WHEN prediction > -0.3 AND prediction < 0.3 THEN 1.0 ELSE 0 END), 6) AS hedging FROM mc GROUP BY 1", views=True)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("dimension").agg(*_rounded(hedging=met.error_measures("prediction", "target")["hedging"]))


@plans.add("m12_calibration", PAIRS + ", ab AS (SELECT *, round(abs(prediction - target), 9) AS err FROM mc), " + RANKS.format(a="uncertainty", b="err", t="ab") + """, c AS (SELECT dimension, corr(x, y) AS rho FROM r GROUP BY 1)
SELECT dimension, round(rho, 6) AS rho, CASE WHEN rho IS NULL THEN 'unknown' WHEN rho >= 0.3 THEN 'good' WHEN rho >= 0.1 THEN 'marginal' WHEN rho >= 0 THEN 'poor' ELSE 'negative' END AS quality FROM c""", views=True)
def _(spark, sf):
    df = _pairs(spark, sf).withColumn("err", F.round(F.abs(F.col("prediction") - F.col("target")), 9))
    return met.spearman(df, ["dimension"], "uncertainty", "err").select("dimension", F.round("rho", 6).alias("rho"), met.calibration_quality(F.col("rho")).alias("quality"))


@plans.add("m14_binary_abstaining", "WITH x AS (SELECT l.dimension, l.score = -1 AS t, CASE d.verdict WHEN 'conflict' THEN true WHEN 'not_conflict' THEN false END AS p FROM label l JOIN decision d ON d.event_id = l.event_id AND d.dimension = l.dimension WHERE l.score IS NOT NULL) SELECT " + BINARY.format(t="t", p="p") + " FROM x", views=True)
def _(spark, sf):
    d = adapter.decision(spark, sf).select(*CELL, "verdict")
    rows = adapter.label(spark, sf).where("score is not null").join(d, CELL)
    v = F.col("verdict")
    return rows.agg(*_binary(F.col("score") == -1, F.when(v == "conflict", True).when(v == "not_conflict", False)))


@plans.add("m15_micro_macro", PAIRS + """, d AS (SELECT dimension, count(*) FILTER (WHERE target = -1 AND predicted = -1) AS tp, count(*) FILTER (WHERE target <> -1 AND predicted = -1) AS fp, count(*) FILTER (WHERE target = -1 AND predicted <> -1) AS fn FROM mc GROUP BY 1)
SELECT round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS micro_f1, round(avg(CASE WHEN tp + fn > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END), 6) AS macro_f1 FROM d""", views=True)
def _(spark, sf):
    t, p = F.col("target") == -1, F.col("predicted") == -1
    d = _pairs(spark, sf).groupBy("dimension").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    f1 = lambda tp, fp, fn: F.try_divide(2 * tp, 2 * tp + fp + fn)
    return d.agg(*_rounded(micro_f1=f1(F.sum("tp"), F.sum("fp"), F.sum("fn")), macro_f1=F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.coalesce(f1(F.col("tp"), F.col("fp"), F.col("fn")), F.lit(0.0))))))


SOFT = """WITH t AS (SELECT event_id, dimension, persona_id, count(*) FILTER (WHERE score = -1) / 5.0 AS a, count(*) FILTER (WHERE score = 0) / 5.0 AS z, count(*) FILTER (WHERE score = 1) / 5.0 AS b FROM vote GROUP BY ALL),
q AS (SELECT *, 0.2 AS pa, 0.5 AS pz, 0.3 AS pb FROM t)
"""


@plans.add("m18_proper_scores", SOFT + "SELECT dimension, round(avg(-(a * ln(0.2) + z * ln(0.5) + b * ln(0.3))), 6) AS nll, round(avg((a - pa) * (a - pa) + (z - pz) * (z - pz) + (b - pb) * (b - pb)), 6) AS brier FROM q GROUP BY 1", views=True)
def _(spark, sf):
    soft = vot.vote_distribution(adapter.vote(spark, sf), CELL).withColumn("q", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    return soft.groupBy("dimension").agg(*_rounded(**met.proper_scores("q", "p")))


@plans.add("m20_confidence_gate", """SELECT persona_id, t_index, dimension, CASE WHEN verdict = 'abstain' THEN NULL WHEN CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END >= 1 THEN verdict = 'conflict' END AS predicted FROM decision""", views=True)
def _(spark, sf):
    rank = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return adapter.decision(spark, sf).select("persona_id", "t_index", "dimension", F.when((F.col("verdict") != "abstain") & (rank >= 1), F.col("verdict") == "conflict").alias("predicted"))
