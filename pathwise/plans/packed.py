"""Packing and splits over the test tables (survey rows Q15, Q18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise import adapter
from pathwise.adapter import table
from pathwise.operators import packing
from pathwise.plans.base import Plans
from pathwise.schema import DIMS

plans = Plans()

PERMUTATIONS, SEED = 64, 7
FLAGS = [f"{side}_{d}" for d in DIMS for side in ("up", "down")]


@plans.add("q15_capped_shards", """WITH RECURSIVE s AS (SELECT o_orderkey AS k, count(l_linenumber) AS n, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
w AS (SELECT k, n, i, 1 AS shard, 1 AS groups, n AS total FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.n, s.i, CASE WHEN w.groups >= 7 OR w.total + s.n > 25 THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.groups >= 7 OR w.total + s.n > 25 THEN 1 ELSE w.groups + 1 END, CASE WHEN w.groups >= 7 OR w.total + s.n > 25 THEN s.n ELSE w.total + s.n END FROM w JOIN s ON s.i = w.i + 1)
SELECT k AS o_orderkey, n, CAST(shard AS BIGINT) AS shard FROM w""")
def _(spark, sf):
    """Orders with their lines packed in order into shards of at most 7 orders and 25 lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    orders = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return packing.capped_shards(orders.select("o_orderkey", F.coalesce("_n", F.lit(0)).alias("n")), "o_orderkey", "n", 7, 25)


def _feistel() -> str:
    """SQL of one walk step of `packing.permuted` on x, with h bits in a half and permutation p."""
    left, right = "(x >> h)", "(x & ((1 << h) - 1))"
    steps = []
    for k in range(packing.ROUNDS):
        mixed = f"(r{k} * {packing.FACTOR} + (p * 7919 + {k * 104_729 + SEED}) * 65537)"
        steps.append(f"(SELECT r{k} AS l{k + 1}, xor(l{k}, xor({mixed} >> 7, {mixed} >> 19) & ((1 << h) - 1)) AS r{k + 1}, p, place, h, n")
    inner = f"(SELECT {left} AS l0, {right} AS r0, p, place, h, n FROM walk WHERE again)"
    for step in steps:
        inner = f"{step} FROM {inner})"
    last = packing.ROUNDS
    return f"SELECT p, place, h, n, (l{last} << h) | r{last} AS x, ((l{last} << h) | r{last}) >= n AS again FROM {inner}"


def _split_sql() -> str:
    flags = ", ".join(f"coalesce(bool_or(score = {1 if f.startswith('up') else -1}) FILTER (WHERE dimension = '{f.split('_', 1)[1]}'), false)::BIGINT AS {f}" for f in FLAGS)
    long = "SELECT f.place, u.feature, u.flag FROM f CROSS JOIN LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in FLAGS) + ") u(feature, flag)"
    return f"""WITH RECURSIVE f AS (SELECT persona_id, row_number() OVER (ORDER BY persona_id) - 1 AS place, {flags} FROM label GROUP BY persona_id),
size AS (SELECT count(*) AS n, greatest(1, (length(CASE WHEN count(*) > 1 THEN bin(count(*) - 1) ELSE '1' END) + 1) // 2) AS h, CAST(floor(count(*) * 0.7) AS BIGINT) AS n_train, CAST(floor(count(*) * 0.15) AS BIGINT) AS n_val FROM f),
walk AS (SELECT p, place, h, n, place AS x, true AS again FROM f, size, (SELECT unnest(range(0, {PERMUTATIONS})) AS p) UNION ALL {_feistel()}),
placed AS (SELECT p, place, x FROM walk WHERE NOT again),
lng AS ({long}), tot AS (SELECT feature, sum(flag) AS total FROM lng GROUP BY 1),
part AS (SELECT placed.p, CASE WHEN x < n_train THEN 'train' WHEN x < n_train + n_val THEN 'val' ELSE 'test' END AS split, placed.place FROM placed, size),
sums AS (SELECT p, split, feature, sum(flag) AS s, count(*) AS m FROM part JOIN lng USING (place) WHERE split <> 'train' GROUP BY ALL),
gaps AS (SELECT p, split, feature, abs(s / m - total / n) AS gap, CASE WHEN s = 0 AND total > 0 AND total * (m / n) >= 1.0 THEN 1 ELSE 0 END AS lacks FROM sums JOIN tot USING (feature), size),
means AS (SELECT p, split, max(gap) AS most, avg(gap) AS mean, sum(lacks) AS lacks FROM gaps GROUP BY ALL),
scores AS (SELECT p, round(max(most) + 0.5 * avg(mean) + 10.0 * sum(lacks), 12) AS score FROM means GROUP BY 1),
best AS (SELECT p, score FROM scores ORDER BY score, p LIMIT 1)
SELECT f.persona_id, part.split, CAST(best.p AS BIGINT) AS permutation, best.score FROM best JOIN part ON part.p = best.p JOIN f ON f.place = part.place"""


@plans.add("q18_stratified_split", adapter.VIEWS.replace("WITH entry", "WITH RECURSIVE entry", 1) + ", " + _split_sql().removeprefix("WITH RECURSIVE "))
def _(spark, sf):
    """Personas split 70 : 15 : 15 by the best of seeded permutations, scored by the shares of 20 sign flags."""
    flag = lambda f: F.coalesce(F.bool_or(F.when(F.col("dimension") == f.split("_", 1)[1], F.col("score") == (1 if f.startswith("up") else -1))), F.lit(False)).cast("long").alias(f)
    flags = adapter.label(spark, sf).groupBy("persona_id").agg(*map(flag, FLAGS))
    n = flags.count()
    return packing.stratified_split(flags, "persona_id", FLAGS, n * 7 // 10, n * 15 // 100, SEED, PERMUTATIONS)
