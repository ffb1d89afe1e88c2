"""Packing and splits against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwise import catalog
from pathwise.operators import packing
from tests.compare import differences, second_engine


@pytest.mark.parametrize("n, groups, size, chunk", [(150, 4, 30, 8), (1, 3, 5, 4), (200, 7, 10**6, 16), (150, 5, 9, 4096)])
def test_capped_shards_against_a_loop(spark, n, groups, size, chunk):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 2, 5, 9, 12, 40]) for _ in range(n)]
    df = spark.createDataFrame([(k * 3, x, "x") for k, x in enumerate(sizes)], "g long, n long, shard string").repartition(5)
    shard, held, total, expected = 1, 0, 0, {}
    for k, x in enumerate(sizes):
        if held >= groups or (held and total + x > size):
            shard, held, total = shard + 1, 0, 0
        held, total, expected[k * 3] = held + 1, total + x, shard
    assert {r["g"]: r["shard"] for r in packing.capped_shards(df, "g", "n", groups, size, chunk).collect()} == expected


def test_shards_and_splits_of_more_rows_than_ranges_are_sampled_from(spark):
    n = 200_000
    df = spark.range(0, n, 1, 4).select(F.col("id").alias("g"), (F.col("id") % 5).alias("n"), F.lit("unread").alias("text"))
    shard, held, total, expected = 1, 0, 0, []
    for x in (k % 5 for k in range(n)):
        if held >= 7 or (held and total + x > 11):
            shard, held, total = shard + 1, 0, 0
        held, total = held + 1, total + x
        expected.append(shard)
    got = {r["g"]: r["shard"] for r in packing.capped_shards(df, "g", "n", 7, 11).collect()}
    assert [got.get(k) for k in range(n)] == expected
    flags = df.select("g", (F.col("g") % 3 == 0).cast("long").alias("a"), "text")
    out = packing.stratified_split(flags, "g", ["a"], int(n * 0.7), int(n * 0.15), 7, 2)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 140_000, "val": 30_000, "test": 30_000}


def test_capped_shards_of_nothing(spark):
    df = spark.createDataFrame([], "g long, n long")
    assert packing.capped_shards(df, "g", "n", 2, 5).count() == 0
    with pytest.raises(ValueError):
        packing.capped_shards(df, "g", "n", 0, 5)


def test_permutations_are_bijections():
    for n in (1, 2, 5, 100, 1000):
        found = packing.permuted(np.arange(n)[None, :], n, np.arange(40)[:, None], 7)
        assert all(sorted(x) == list(range(n)) for x in found.tolist())
    assert len({tuple(x) for x in found.tolist()}) == 40


def test_split_against_a_loop(spark):
    rng = random.Random(3)
    names = ["a", "b", "c"]
    rows = [(k, int(rng.random() < 0.5), int(rng.random() < 0.1), int(k == 7)) for k in range(60)]
    out = {r["k"]: r for r in packing.stratified_split(spark.createDataFrame(rows, "k long, a int, b int, c int").repartition(5), "k", names, 40, 10, 7, 300).collect()}
    matrix, scores = np.array([r[1:] for r in rows], float), []
    for p in range(300):
        at, gaps, means, lacks = packing.permuted(np.arange(60), 60, np.int64(p), 7), [], [], 0
        for part in ((at >= 40) & (at < 50), at >= 50):
            gap = np.abs(matrix[part].mean(0) - matrix.mean(0))
            gaps, means = [*gaps, gap.max()], [*means, gap.mean()]
            lacks += int(((matrix[part].sum(0) == 0) & (matrix.sum(0) > 0) & (matrix.sum(0) * part.sum() / 60 >= 1)).sum())
        scores.append(round(max(gaps) + 0.5 * float(np.mean(means)) + 10 * lacks, 12))
    best = scores.index(min(scores))
    at = packing.permuted(np.arange(60), 60, np.int64(best), 7)
    assert {k: r["split"] for k, r in out.items()} == {k: "train" if at[k] < 40 else "val" if at[k] < 50 else "test" for k in range(60)}
    assert {(r["permutation"], r["score"]) for r in out.values()} == {(best, min(scores))}
    assert packing.stratified_split(spark.createDataFrame([], "k long, a int"), "k", ["a"], 1, 1).count() == 0


def test_split_sizes_are_exact_shares_of_the_rows(spark, tmp_path):
    """0.7 times 90, as doubles, is less than 63."""
    events = spark.range(270).selectExpr("id AS event_id", "timestamp_seconds(id * 3600) AS ts", "id % 90 AS user_id", "'view' AS event_type", "1D AS value", "concat('{\"k\": ', id % 17, '}') AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    con, name = second_engine("/none"), "q18_stratified_split"
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert differences(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name]) == ""
